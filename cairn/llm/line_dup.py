"""Removal of runs of lines that stand earlier in the corpus, by winnowing over line hashes. DataFrame functions only.

Lines are cut at ``\\n`` and compared without surrounding blanks; blank lines do not count. A run of ``min_run`` lines goes
if the same run stands earlier: in a document of smaller id, or further up in the same document. Longer repeated runs go
whole, as each of their windows is such a run. With ``long_line`` a single line of at least so many words goes as well if
it stands earlier, whatever its neighbours; shorter lines still need a repeated neighbour, so that headings, list marks and
brackets stay. The query and the pipeline take ``LONG_LINE``.

1. Winnowing: of every window of ``min_run`` lines the least hash is a fingerprint. Equal windows have equal fingerprints,
   so every repeated run is guaranteed to share one. A long line is a window of its own.
2. Fingerprints that occur more than once in the corpus are joined back to the windows.
3. Matches extend both ways as the windows around shared fingerprints; the earliest place of each window stays.
4. The union of the later windows is cut out of the texts.

A line that a large part of the documents has is one key of the joins in steps 2 and 3; its rows are on the left of a semi and a
left join, which adaptive execution splits. All counts are aggregated before they move.

Cases: null and empty texts have no lines and come back as they are; texts that lose nothing come back unchanged, blank
lines included; a null id counts as larger than all; rows that repeat id and text get the same result each; different
texts under one id never remove from each other; extra columns stay as they are; windows are compared
by hashes of 128 bits (fingerprints have 64: equal ones of different lines cost rows, not results).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.storage import Scratch

MIN_RUN = 2
LONG_LINE = 6
LAST = (1 << 63) - 1
_KEYS = ["__ord", "__th"]


def _lines(text_col: str):
    return F.split(F.col(text_col).cast("string"), "\n", -1)


def _filled(lines):
    """(place, line) of the lines that are not blank."""
    placed = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("x")))
    return F.filter(placed, lambda s: s["x"] != "")


def repeated_runs(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, min_run: int, long_line: int | None = None) -> DataFrame:
    """(__ord, __th, gone): sorted lines, counted without blank ones, of the windows that stand earlier."""

    def hashes(filled):
        words = lambda s: F.regexp_count(s["x"], F.lit(r"\S+"))
        long = F.filter(F.transform(filled, lambda s, i: F.when(words(s) >= long_line, i + 1)), lambda p: p.isNotNull()) if long_line else F.array().cast("array<int>")
        return F.struct(F.transform(filled, lambda s: F.xxhash64(s["x"])).alias("h"), F.transform(filled, lambda s: F.xxhash64(F.lit(1), s["x"])).alias("h2"), long.alias("long"))

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("__ord"), F.xxhash64(F.col(text_col).cast("string")).alias("__th"), F.transform(F.array(_filled(_lines(text_col))), hashes)[0].alias("x"))
    hashed = scratch.write(rows.select(*_KEYS, "x.h", "x.h2", "x.long").where((F.size("h") >= min_run) | (F.size("long") > 0)))
    starts = F.when(F.size("h") >= min_run, F.sequence(F.lit(1), F.size("h") - (min_run - 1))).otherwise(F.array().cast("array<int>"))
    window = lambda s, k, h="h": F.slice(h, s, k)
    windows = lambda starts, k: F.transform(starts, lambda s: F.struct((s - 1).alias("s"), F.lit(k).alias("k"), F.xxhash64(window(s, k)).alias("w"), F.xxhash64(window(s, k, "h2")).alias("w2"), F.array_min(window(s, k)).alias("f")))
    least = F.transform(starts, lambda s: s + F.array_position(window(s, min_run), F.array_min(window(s, min_run))).cast("int") - 1)
    marks = scratch.write(
        hashed.select(
            *_KEYS,
            F.concat(windows(starts, min_run), windows(F.col("long"), 1)).alias("windows"),
            F.transform(F.array_distinct(F.concat(least, F.col("long"))), lambda p: F.element_at("h", p)).alias("fingerprints"),
        )
    )
    shared = scratch.write(marks.select(F.explode("fingerprints").alias("f")).groupBy("f").agg(F.count("*").alias("c")).where("c > 1").select("f"))
    near = marks.select(*_KEYS, F.explode("windows").alias("x")).select(*_KEYS, "x.s", "x.k", "x.w", "x.w2", "x.f").join(shared, "f", "left_semi")
    places = scratch.write(near.groupBy(*_KEYS, "w", "w2").agg(F.max("k").alias("k"), F.sort_array(F.collect_set("s")).alias("at")))
    first = scratch.write(places.groupBy("w", "w2").agg(F.min("__ord").alias("first"), F.max("__ord").alias("last")).where("first < last"))
    later = places.join(first, ["w", "w2"], "left").select(*_KEYS, "k", F.when(F.col("first") < F.col("__ord"), F.col("at")).otherwise(F.slice("at", F.lit(2), F.size("at"))).alias("at"))
    lines = F.flatten(F.transform("at", lambda s: F.sequence(s, s + F.col("k") - 1)))
    out = later.where(F.size("at") > 0).groupBy(*_KEYS).agg(F.collect_list(lines).alias("at")).select(*_KEYS, F.sort_array(F.array_distinct(F.flatten("at"))).alias("gone"))
    out = scratch.write(out)
    scratch.drop(hashed, marks, shared, places, first)
    return out


def line_runs_removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, long_line: int | None = None) -> DataFrame:
    """The rows of ``df`` with their text after removal, plus ``n_lines`` and ``n_removed`` (lines that are not blank)."""
    if min_run < 1:
        raise ValueError("a run has one line at least")
    if long_line is not None and long_line < 1:
        raise ValueError("a long line has one word at least")
    scratch = Scratch(df.sparkSession, "line-dup")
    gone = repeated_runs(df, scratch, id_col, text_col, min_run, long_line)
    # runs of overlapping or touching windows, as first and last line
    first = F.filter("gone", lambda x, i: (i == 0) | (x > F.element_at("gone", F.greatest(i, F.lit(1))) + 1))
    last = F.filter("gone", lambda x, i: (i == F.size("gone") - 1) | (F.element_at("gone", F.least(i + 2, F.size("gone"))) > x + 1))
    runs = gone.select(*_KEYS, F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("__runs"))
    keyed = df.withColumns({"__ord": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__th": F.xxhash64(F.col(text_col).cast("string"))})
    out = keyed.join(runs.hint("merge"), _KEYS, "left")  # one plan for every size of input

    def cut(lines):
        """Kept stretches of lines; lambda variables keep each array from being made anew for every element."""
        places = F.transform(_filled(lines), lambda s: s["i"])
        ends = F.transform(
            F.array(places),
            lambda p: F.transform(F.col("__runs"), lambda r: F.struct(F.element_at(p, r["a"] + 1).alias("a"), F.element_at(p, r["b"] + 1).alias("b"))),
        )[0]
        kept = F.transform(
            F.array(ends),
            lambda e: F.transform(
                F.sequence(F.lit(0), F.size(e)),
                lambda k: F.struct(
                    F.when(k == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(k, F.lit(1)))["b"] + 1).alias("from"),
                    F.when(k == F.size(e), F.size(lines)).otherwise(F.element_at(e, F.least(k + 1, F.size(e)))["a"]).alias("to"),
                ),
            ),
        )[0]
        return F.transform(F.array(lines), lambda all_lines: F.flatten(F.transform(kept, lambda g: F.slice(all_lines, g["from"] + 1, g["to"] - g["from"]))))[0]

    text = F.col(text_col).cast("string")
    removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0)).cast("long")
    out = out.withColumns({"__n": F.coalesce(F.size(_filled(_lines(text_col))), F.lit(0)).cast("long"), "__gone": removed, "__text": F.when(F.col("__runs").isNull(), text).otherwise(F.array_join(cut(_lines(text_col)), "\n"))})
    return out.select(*(F.col("__text").alias(c) if c == text_col else F.col(c) for c in df.columns), F.greatest(F.col("__n"), F.lit(0).cast("long")).alias("n_lines"), F.col("__gone").alias("n_removed"))


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN, long_line: int | None = LONG_LINE) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) of each row (null text: null digest)."""
    out = line_runs_removed(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id", "text", min_run, long_line)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same result by brute force over all windows and long lines, for DuckDB (``MIN_RUN`` = 2, ``LONG_LINE`` = 6).
ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, i, line, trim(line, ' ') AS x
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), filled AS (
    SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM lines WHERE x <> ''
), windows AS (
    SELECT a.doc_id, a.r, a.x AS x, b.x AS y FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.r = a.r + 1
), ranked AS (
    SELECT doc_id, r, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, r) AS k FROM windows
), long AS (
    SELECT doc_id, r, row_number() OVER (PARTITION BY x ORDER BY doc_id, r) AS k FROM filled WHERE len(regexp_extract_all(x, '\S+')) >= 6
), gone AS (
    SELECT doc_id, r FROM ranked WHERE k > 1 UNION SELECT doc_id, r + 1 FROM ranked WHERE k > 1 UNION SELECT doc_id, r FROM long WHERE k > 1
), spans AS (
    SELECT f.doc_id, f.i, g.r IS NOT NULL AS dead, f.r,
           max(CASE WHEN g.r IS NULL THEN f.r END) OVER (PARTITION BY f.doc_id ORDER BY f.r) AS before
    FROM filled f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.r = g.r
), marked AS (
    SELECT l.doc_id, l.i, l.line, l.x, s.dead,
           last_value(s.dead IGNORE NULLS) OVER w AS left_dead, last_value(s.r IGNORE NULLS) OVER w AS left_r
    FROM lines l LEFT JOIN spans s ON l.doc_id = s.doc_id AND l.i = s.i
    WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.i ROWS UNBOUNDED PRECEDING)
), decided AS (
    SELECT m.doc_id, m.i, m.line, m.x, CASE WHEN m.x <> '' THEN m.dead ELSE coalesce(m.left_dead, false) AND coalesce(n.dead, false) END AS dead
    FROM marked m LEFT JOIN spans n ON m.doc_id = n.doc_id AND n.r = coalesce(m.left_r, 0) + 1
), counted AS (
    SELECT doc_id, count(*) FILTER (WHERE x <> '') AS n_lines, count(*) FILTER (WHERE x <> '' AND dead) AS n_removed,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dead), '')) AS kept_sha256
    FROM decided GROUP BY doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_removed, 0) AS n_removed, c.kept_sha256
FROM documents d LEFT JOIN counted c ON d.doc_id = c.doc_id
"""
