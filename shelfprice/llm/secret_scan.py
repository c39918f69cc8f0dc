"""Secret scans with a ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text: equal texts, whatever their
paths and however long ago, are one blob. The ledger, a table in a folder, has a row for each blob and
the rules (kind and version) that it was scanned by, with the spans they found. A scan

1. addresses all versions given,
2. finds the pairs of blob and rule that the ledger does not have,
3. reads only the texts of those blobs, once each and by the missing rules only, and appends to the ledger,
4. joins the findings of the ledger back to all paths.

A new version of a rule makes its pairs unseen again; the spans of earlier versions stay in the
ledger but are not reported.

How it scales:

* What is unseen is decided on addresses alone. Texts move once at most, to their blob, copies combined
  map-side, so a text with very many paths is one row per task. When little is unseen,
  its addresses are broadcast, behind a check of their size, and no other text moves.
* Findings join the paths with hot blobs spread (``lookup``); a blob without findings has no row there.
* An append is committed as a whole, so a scan that is cut off leaves the ledger as it was; scans
  that overlap may record a pair twice, which changes no finding.
* All patterns read a text in time linear in its length.

Defined results: a null text is empty; rows without path and repeated rows have a row each;
an empty table gives an empty result and leaves the ledger as it is; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.operators.joins import fits_broadcast, lookup
from shelfprice.operators.staging import stage
from shelfprice.session import scratch_dir


class Rule(NamedTuple):
    """A kind of secret: leftmost matches that do not overlap, dropped if ``group`` has fewer than ``least`` characters.

    ``marks`` are small-letter strings of which one is in every text with a match, if the pattern itself
    would be slow to exclude that.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    marks: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_KINDS = ["assign", "access", "hex"]
# What the usual kinds of secrets look like.
RULES = [
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True,
         ("passw", "secret", "token", "api")),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("session", 1, "ASIA[A-Z0-9]{16,}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", 1, "AIza[A-Za-z0-9_-]{35,}"),
    Rule("web_token", 1, r"eyJ([A-Za-z0-9_-]+)((?:\.[A-Za-z0-9_-]+)*)", 2, 20),
    Rule("url_login", 1, r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
]
_SPANS = "array<struct<rule string, start int, end int>>"
LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


class Scanner:
    """Compiled rules; spans are in code points, the end exclusive."""

    def __init__(self, rules: Sequence[Rule]):
        # letters in either case are those of ASCII
        self._rules = {r.name: (r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0))) for r in rules}

    def spans(self, text: str, names: Sequence[str]) -> list[tuple[str, int, int]]:
        found, small = [], None
        for name in names:
            rule, pattern = self._rules[name]
            if rule.marks:
                small = text.lower() if small is None else small
                if not any(mark in small for mark in rule.marks):
                    continue
            found += [(name, *m.span()) for m in pattern.finditer(text) if len(m[rule.group]) >= rule.least]
        return found


def address(text: Column) -> Column:
    """Content address of a text: its SHA-256 in hex."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger of a folder, or None if nothing was ever scanned."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(folder)


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """(blob, rules): the names of the rules by which each of these distinct blobs has yet to be scanned."""
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    if ledger is None:
        return blobs.withColumn("rules", names)
    done = ledger.select("blob", F.explode("rules").alias("rule")).where(F.col("rule").isin([r.name for r in rules]))
    per_blob = done.groupBy("blob").agg(F.collect_set("rule").alias("done"))  # no more than there are rules
    missing = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(per_blob, "blob", "left").select("blob", missing.alias("rules")).where(F.size("rules") > 0)


def scanned(versions: DataFrame, pending: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows of the pending pairs; ``versions`` has blob and text."""
    if fits_broadcast(pending):
        versions = versions.join(F.broadcast(pending.select("blob")), "blob", "left_semi")
    texts = versions.groupBy("blob").agg(F.first("text").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [
                [{"rule": r, "start": a, "end": b} for r, a, b in scanner.spans(text.as_py() or "", names.as_py())]
                for text, names in zip(batch.column("text"), batch.column("rules"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), batch.column("rules"), pa.array(spans, kind)], ["blob", "rules", "spans"])

    return texts.join(pending, "blob").select("blob", "rules", "text").mapInArrow(scan, LEDGER)


def findings(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, spans) of the blobs in which the rules found something, spans by start and by the order of the rules."""
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    one = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("span")).where(
        F.col("span.rule").isin([r.name for r in rules]))
    spans = F.sort_array(F.collect_set(F.struct(  # those of one text
        F.col("span.start").alias("start"), order[F.col("span.rule")].alias("place"),
        F.col("span.end").alias("end"), kinds[F.col("span.rule")].alias("kind"))))
    return one.groupBy("blob").agg(spans.alias("spans"))


def scan(
    versions: DataFrame, ledger: str, path: Sequence[str] = ("doc_id",), text: str = "text", rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """``path`` columns, content address ``blob`` and ``spans`` (start, place, end, kind) of every version.

    ``ledger`` is the folder of the ledger, which gets the rows of what was unseen.
    """
    spark = versions.sparkSession
    named = versions.select(F.struct(*[F.col(f"`{c}`") for c in path]).alias("path"), F.col(f"`{text}`").alias("text"))
    addressed = named.withColumn("blob", address(F.col("text")))
    paths = stage(addressed.select("path", "blob"))
    pending = stage(unseen(paths.select("blob").distinct(), read_ledger(spark, ledger), rules))
    if not pending.isEmpty():
        scanned(addressed.select("blob", "text"), pending, rules).write.mode("append").parquet(ledger)
    book = read_ledger(spark, ledger)
    found = findings(spark.createDataFrame([], LEDGER) if book is None else book, rules)
    joined = lookup(paths, stage(found), "blob", "left")
    none = F.array().cast("array<struct<start int, place int, end int, kind string>>")
    return joined.select("path.*", "blob", F.coalesce("spans", none).alias("spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secrets(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Counts of the base kinds, a checksum of their spans, and all spans of every document.

    Without a ``ledger`` a new one is begun in the shared folder.
    """
    folder = ledger or f"{scratch_dir(docs.sparkSession)}/ledger-{uuid.uuid4().hex}"
    found = scan(docs, folder)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined_spans(of(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
