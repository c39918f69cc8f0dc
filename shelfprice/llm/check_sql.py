"""DuckDB SQL that must give the rows of the queries that SQL can express, on whole tables."""

from __future__ import annotations

from shelfprice.llm import license_scan, quality_rules, substring_dedup

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    known = "MAP {" + ", ".join(f"{quoted(s)}: {quoted(k)}" for k, s in license_scan.SENTENCES.items()) + "}"
    steps, before = [], "first"
    for k, (_, ids) in enumerate(license_scan.RULES):
        rule = quoted("".join(f"<{i}>" for i in ids))
        steps.append(f"r{k} AS (SELECT *, contains(rest{k}, {rule}) AS hit{k}, replace(rest{k}, {rule}, '#') AS rest{k + 1} FROM {before})")
        before = f"r{k}"
    names = ", ".join(f"CASE WHEN hit{k} THEN {quoted(name)} END" for k, (name, _) in enumerate(license_scan.RULES))
    return rf"""
WITH parts AS (
    SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(license_scan.MARKS)}) THEN list_filter(list_transform(
        string_split(regexp_replace(text, '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: length(x) > 0) ELSE [] END AS normal
    FROM documents),
found AS (
    SELECT doc_id, list_filter(list_transform(normal, lambda x: map_extract({known}, x)[1]), lambda x: x IS NOT NULL) AS ids,
           len(list_filter(normal, lambda x: regexp_matches(x, '\blicen[sc]e') AND len(map_extract({known}, x)) = 0)) AS n_unknown
    FROM parts),
first AS (SELECT *, coalesce(array_to_string(list_transform(ids, lambda x: '<' || x || '>'), ''), '') AS rest0 FROM found),
{", ".join(steps)}
SELECT doc_id, nullif(array_to_string(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))), ';'), '') AS licenses,
       CAST(len(ids) AS BIGINT) AS n_sentences, CAST(n_unknown AS BIGINT) AS n_unknown,
       coalesce(array_to_string(ids, ';'), '') AS identifiers
FROM {before}
"""


def substring_sql() -> str:
    n = substring_dedup.WINDOW
    return f"""
WITH texts AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS pos FROM texts WHERE len(w) >= {n}),
keyed AS (SELECT s.doc_id, s.pos, md5(array_to_string(w[s.pos:s.pos + {n - 1}], ' ')) AS window_key FROM starts s JOIN texts USING (doc_id)),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY window_key ORDER BY doc_id, pos) AS turn FROM keyed) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {n})) AS pos FROM later),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM texts),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


def quality_sql() -> str:
    limits = quality_rules.Limits()
    space = r"[\x20\x09-\x0D]"
    classes = [c.replace("'", "''") for c in quality_rules.CLASSES]
    size = len(classes) + 1
    counts = ", ".join(f"length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{c}]', '', 'g')) AS c{k}"
                       for k, c in enumerate(classes))
    every = " + ".join(f"c{k}" for k in range(size - 1))
    n = quality_rules.N_WORDS
    lists = "CASE lang " + " ".join(
        f"WHEN {quoted(code)} THEN [{', '.join(quoted(w) for w in line.split()[:n])}]"
        for code, line in quality_rules.COMMON_WORDS.items()) + " END"

    def half(p: str, q: str) -> str:
        return f"CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0.0 END"

    def distance(name: str, reference: str, length: int) -> str:
        parts = [(f"({name}[{k}] / list_sum({name})::DOUBLE)", f"({reference}[{k}] / list_sum({reference})::DOUBLE)")
                 for k in range(1, length + 1)]
        total = " + ".join(f"{half(p, q)} + {half(q, p)}" for p, q in parts)
        return f"CASE WHEN list_sum({name}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(({total}) / 2, 0.0)) END"

    return rf"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, lang, text, {WORDS} AS w FROM documents),
grams AS (SELECT id, unnest(range(1, len(w) - 1)) AS pos FROM texts WHERE len(w) >= 3),
named AS (SELECT g.id, g.pos, w[g.pos] || ' ' || w[g.pos + 1] || ' ' || w[g.pos + 2] AS gram FROM grams g JOIN texts USING (id)),
twice AS (SELECT id, pos FROM (SELECT *, count(*) OVER (PARTITION BY id, gram) AS n FROM named) WHERE n > 1),
covered AS (SELECT id, count(*) AS n_repeat FROM (SELECT DISTINCT id, unnest(range(pos, pos + 3)) AS pos FROM twice) GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM texts)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
counted AS (SELECT id, doc_id, lang, w, text, {counts}, {lists} AS listed FROM texts),
words AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(w) AS word FROM texts) GROUP BY ALL),
common AS (SELECT id, list(coalesce(n, 0) ORDER BY place) AS hits
           FROM (SELECT id, unnest(listed) AS word, unnest(range(1, {n + 1})) AS place FROM counted) LEFT JOIN words USING (id, word) GROUP BY id),
measured AS (
    SELECT c.doc_id, c.lang, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(coalesce(text, ''), '{space}', '', 'g')) AS BIGINT) AS word_chars, CAST(c2 AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
           [{", ".join(f"c{k}" for k in range(size - 1))}, length(coalesce(text, '')) - ({every})] AS classes,
           list_append(hits, len(w) - list_sum(hits)) AS common
    FROM counted c LEFT JOIN covered USING (id) LEFT JOIN lines USING (id) LEFT JOIN common USING (id)),
based AS (SELECT *, n_words < {limits.least_words} OR 100 * n_repeat_words > {limits.most_repeated_pct} * n_words AS base_failed FROM measured),
refs AS (SELECT lang AS of_lang, [{", ".join(f"sum(classes[{k}])" for k in range(1, size + 1))}] AS class_ref,
                [{", ".join(f"sum(common[{k}])" for k in range(1, n + 2))}] AS common_ref FROM based WHERE NOT base_failed GROUP BY lang),
judged AS (SELECT *, {distance("classes", "class_ref", size)} AS class_distance, {distance("common", "common_ref", n + 1)} AS word_distance
           FROM based LEFT JOIN refs ON lang IS NOT DISTINCT FROM of_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance,
       NOT base_failed AND NOT (coalesce(class_distance, 0) > {limits.class_distance} AND word_chars >= {limits.class_least_chars})
           AND NOT (coalesce(word_distance, 0) > {limits.word_distance} AND n_words >= {limits.word_least_words}) AS kept
FROM judged
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, e.x)])"
    steps = [f"""
kept AS (
  SELECT vec_id, label, [CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT) for v in embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([v for v in embedding if v IS NULL OR NOT isfinite(v)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, label, part, x[part * len(x) // {parts} + 1 : (part + 1) * len(x) // {parts}] AS x
  FROM kept, range({parts}) AS r(part)
), book0 AS MATERIALIZED (
  SELECT part, entry, p.x
  FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}) JOIN parts p USING (vec_id)
)"""]

    def nearest(k: int, what: str) -> str:
        return f"""SELECT {what}, arg_min(struct_pack(entry := e.entry, d := d), d * {entries} + e.entry) AS best
  FROM (SELECT p.vec_id, p.label, p.part, p.x, e.entry, {distance} AS d FROM parts p JOIN book{k} e USING (part)) e
  GROUP BY {what}"""

    for k in range(rounds):
        steps.append(f"""near{k} AS MATERIALIZED (
  {nearest(k, 'vec_id, part, x')}
), mean{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x
  FROM (SELECT part, best.entry AS entry, place, sum(x[place + 1]) AS s, count(*) AS n
        FROM near{k}, range((SELECT max(len(x)) FROM parts)) AS c(place) GROUP BY ALL)
  GROUP BY part, entry
), book{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{k} b LEFT JOIN mean{k} m USING (part, entry)
)""")
    steps.append(f"""coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM ({nearest(rounds, 'vec_id, label, part')}) GROUP BY vec_id, label
), books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books""")
    return "WITH " + ", ".join(s.strip() for s in steps)


def secrets_sql() -> str:
    """Starts of matches from the lengths of the pieces between them."""
    # Kind, pattern, group and its least length, in the order of the kinds.
    word = "[A-Za-z0-9_-]"
    kinds = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
                   r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24), ("session", "ASIA[A-Z0-9]+", 0, 20),
        ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
        ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15), ("google", f"AIza{word}+", 0, 39),
        ("web_token", rf"eyJ({word}+)((?:\.{word}+)*)", 2, 20),
        ("url_login", r"://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 0),
    ]
    found = " UNION ALL ".join(f"""
  SELECT row, {place} AS place, {quoted(kind)} AS kind, unnest(range(1, len(hits) + 1)) AS i, hits, groups, pieces, {least} AS least
  FROM (SELECT row, regexp_extract_all(text, {quoted(pattern)}) AS hits, regexp_extract_all(text, {quoted(pattern)}, {group}) AS groups,
               regexp_split_to_array(text, {quoted(pattern)}) AS pieces
        FROM rows WHERE regexp_matches(text, {quoted(pattern)}))""" for place, (kind, pattern, group, least) in enumerate(kinds))
    return f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
spans AS (
  SELECT row, place, kind, begun AS s, begun + length(hits[i]) AS e FROM (
    SELECT *, CAST(list_sum([length(p) FOR p IN pieces[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS BIGINT) AS begun
    FROM found WHERE length(groups[i]) >= least)
), listed AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, place) FILTER (place < 3) AS base,
         string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, place) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM rows LEFT JOIN listed USING (row)
"""


ORACLE_SQL = {
    "op6_substring_dedup": substring_sql(),
    "op7_quality_rules": quality_sql(),
    "op8_license_scan": license_sql(),
    "op12_secret_scan": secrets_sql(),
    "op13_vector_codes": codes_sql(),
}
