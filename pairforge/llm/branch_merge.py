"""Three-way merge of two branches of a table of documents, by a sweep over sorted versions.

Every unit of a document (the row itself, its columns, each line of its text, the gap after each line, and a
row that a branch adds) has a base version and at most one version a branch. Versions are tagged, dealt out by
document, sorted by document, unit and branch, and one pass over them, which holds a document at most, compares
the three cursors of each unit. A branch that leaves a unit alone sends no version, so the shuffle holds the base
and what was edited.

Results in odd cases:

* nulls in text, lang and source are empty; a null id is an id like others;
* an empty text is one empty line; a text whose lines are all dropped is empty;
* of rows that repeat an id, the smallest by (text, lang, source) is the document;
* a row that a branch adds under an id of the base has no effect, as that id is taken;
* an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.llm import common

#: Cursors of a unit: the base and the two branches; a conflict takes the state of the last.
BASE, LEFT, RIGHT = 0, 1, 2
BRANCHES = {"L": LEFT, "R": RIGHT}
#: What a unit is. Units of a document sort by kind and then by place; a line comes before the gap after it.
ROW, COLUMN, LINE, ADDED = 0, 1, 2, 3
COLUMNS = ("lang", "source")

TAGGED = "doc_id long, kind int, place int, slot int, branch int, present boolean, value string, lang string, source string"
MERGED = "doc_id long, present boolean, lang string, source string, text string, n_clean long, n_edit_edit long, n_edit_delete long, n_insert_insert long"


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, source) without nulls but in the id, each id once.

    Ids that repeat are looked for in the column of ids alone; only their rows are gathered, combined before the shuffle.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", *COLUMNS)))
    repeated, _ = common.materialize(spark, rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")), "repeated-ids")
    if repeated.isEmpty():
        return rows
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    smallest = rows.join(repeated, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *COLUMNS)).alias("r")).select("doc_id", "r.*")
    return rows.join(repeated, same, "left_anti").unionByName(smallest)


def _version(kind: int, place, slot: int, branch: int, present: bool = True, value: Column | None = None, lang: Column | None = None, source: Column | None = None) -> Column:
    empty = F.lit(None).cast("string")
    texts = {"value": value, "lang": lang, "source": source}
    fields = [F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in (("kind", kind), ("place", place), ("slot", slot), ("branch", branch))]
    return F.struct(*fields, F.lit(present).alias("present"), *((empty if x is None else x).alias(n) for n, x in texts.items()))


def edit_code(branch: str, name: Column) -> Column:
    """Which edit a branch makes to a unit: a number below 7."""
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(F.concat(F.lit(f"{branch}:"), id_text, F.lit(":"), name).cast("binary")), F.lit(7)).cast("int")


def _exploded(rows: DataFrame, versions: list[Column], doc_id: Column | None = None) -> DataFrame:
    some = F.explode(F.filter(F.array(*versions), lambda v: v.isNotNull())).alias("v")
    return rows.select((F.col("doc_id") if doc_id is None else doc_id).alias("doc_id"), some).select("doc_id", "v.*")


def simulated_branches(base: DataFrame) -> DataFrame:
    """Tagged versions of base (one row per id, no null texts) and of branches L and R, edited by the codes of their units.

    Code 0 drops a row or line and empties a column; 1 and 2 append ! or ? to a line or column; 3 and 4 insert a line ! or ?
    after a line, or add a row -1 - doc_id of that text.
    """
    mark = lambda code, first: F.when(code == first, F.lit("!")).otherwise(F.lit("?"))
    of_row, added = [_version(ROW, 0, 0, BASE)], []
    for b, branch in BRANCHES.items():
        code = edit_code(b, F.lit("row"))
        of_row.append(F.when(code == 0, _version(ROW, 0, 0, branch, present=False)))
        added.append(F.when(code.isin(3, 4), _version(ADDED, 0, 0, branch, value=mark(code, 3), lang=F.col("lang"), source=F.col("source"))))
    for place, name in enumerate(COLUMNS):
        of_row.append(_version(COLUMN, place, 0, BASE, value=F.col(name)))
        for b, branch in BRANCHES.items():
            code = edit_code(b, F.lit(name))
            new = F.when(code == 0, F.lit("")).otherwise(F.concat(F.col(name), mark(code, 1)))
            of_row.append(F.when(code <= 2, _version(COLUMN, place, 0, branch, value=new)))
    lines = base.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("place", "value"))
    for b in BRANCHES:
        lines = lines.withColumn(f"code_{b}", edit_code(b, F.col("place").cast("string")))
    of_line = [_version(LINE, F.col("place"), 0, BASE, value=F.col("value"))]
    for b, branch in BRANCHES.items():
        code = F.col(f"code_{b}")
        of_line += [
            F.when(code == 0, _version(LINE, F.col("place"), 0, branch, present=False)),
            F.when(code.isin(1, 2), _version(LINE, F.col("place"), 0, branch, value=F.concat(F.col("value"), mark(code, 1)))),
            F.when(code.isin(3, 4), _version(LINE, F.col("place"), 1, branch, value=mark(code, 3))),
        ]
    return _exploded(base, of_row).unionByName(_exploded(lines, of_line)).unionByName(_exploded(base, added, -1 - F.col("doc_id")))


class _Document:
    """What is known of one id while its units go by."""

    __slots__ = ("changed", "counts", "doc_id", "dropped", "found", "in_base", "lines", "values")

    def __init__(self, doc_id):
        self.doc_id = doc_id
        self.in_base = self.found = False
        self.dropped = [False, False, False]
        self.changed = [False, False, False]
        self.counts = [0, 0, 0, 0]
        self.values = ["", ""]
        self.lines: list[str] = []

    def unit(self, kind: int, place: int, slot: int, cursors: list) -> None:
        """Merges the versions at the three cursors: None where a branch has none, else (present, value, lang, source)."""
        base, left, right = cursors
        if kind == ROW:
            self.in_base = self.found = base is not None
            self.dropped = [x is not None and not x[0] for x in cursors]
            return
        if kind == ADDED:
            if self.in_base:
                return
            self.found = True
        left_new, right_new = left is not None and left != base, right is not None and right != base
        self.changed[LEFT] |= left_new
        self.changed[RIGHT] |= right_new
        state = right if right_new else left if left_new else base
        if left_new and right_new and left != right:
            if base is None:
                self.counts[3] += 1
            else:
                self.counts[1 if left[0] and right[0] else 2] += 1
        elif left_new or right_new:
            self.counts[0] += 1
        if self.dropped[LEFT]:
            state = right if right_new else base
        if kind == COLUMN:
            self.values[place] = state[1]
        elif kind == ADDED:
            self.lines, self.values = [state[1]], [state[2], state[3]]
        elif state is not None and state[0]:
            self.lines.append(state[1])

    def result(self) -> tuple:
        present = self.found
        if self.dropped[LEFT] or self.dropped[RIGHT]:
            kept = RIGHT if self.dropped[LEFT] else LEFT
            conflict = not (self.dropped[LEFT] and self.dropped[RIGHT]) and self.changed[kept]
            self.counts = [int(not conflict), 0, int(conflict), 0]
            present = conflict and kept == RIGHT
        return (self.doc_id, present, *(self.values if present else (None, None)), "\n".join(self.lines) if present else None, *self.counts)


def three_cursor_merge(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Merged documents of versions sorted by document, unit and branch: a version is a row of TAGGED, a document one of MERGED."""
    doc, unit, cursors = None, None, [None, None, None]
    for doc_id, kind, place, slot, branch, *version in rows:
        new_document = doc is None or doc_id != doc.doc_id
        if new_document or (kind, place, slot) != unit:
            if doc is not None:
                doc.unit(*unit, cursors)
            if new_document:
                if doc is not None:
                    yield doc.result()
                doc = _Document(doc_id)
            unit, cursors = (kind, place, slot), [None, None, None]
        cursors[branch] = version
    if doc is not None:
        doc.unit(*unit, cursors)
        yield doc.result()


def _sweep(batch_bytes: int):
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in MERGED.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                yield from zip(*(c.to_pylist() for c in batch.slice(a, 2048).columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for doc in three_cursor_merge(rows(batches)):
            done.append(doc)
            size += 64 + len(doc[4] or "")
            if size >= batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done, size = [], 0
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return run


def merge_branches(tagged: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """MERGED: one row per id that any version names, of a table of TAGGED versions.

    A unit that one branch changed, or both alike, is one clean merge; others are one conflict and take branch R's state. A
    dropped row counts alone: a conflict if the other branch keeps the row and changed its columns, lines or gaps, else clean.
    present is false, and the values null, where the merge has no such row.
    """
    common.ship(tagged.sparkSession)
    ordered = tagged.repartition("doc_id").sortWithinPartitions("doc_id", "kind", "place", "slot", "branch")
    return ordered.select(*(c.split()[0] for c in TAGGED.split(", "))).mapInArrow(_sweep(batch_bytes), MERGED)


def merge_documents(docs: DataFrame) -> DataFrame:
    """MERGED of the simulated branches of documents."""
    return merge_branches(simulated_branches(one_row_per_id(docs)))


def op11_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches L and R of documents, merged."""
    merged = merge_documents(common.table(spark, sf_dir, "documents"))
    return merged.select("doc_id", "lang", "source", F.sha2(F.col("text"), 256).alias("text_sha256"), "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII text."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(steps[1 + (xor(c, b) & 255)], c >> 8)), 4294967295)"


ORACLE = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT for k in range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
base AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
units AS (
  SELECT doc_id, 'row' AS name, 0 AS kind, 0 AS place, NULL AS v FROM base
  UNION ALL SELECT doc_id, 'lang', 1, 0, lang FROM base UNION ALL SELECT doc_id, 'source', 1, 1, source FROM base
  UNION ALL SELECT doc_id, (i - 1)::VARCHAR, 2, i::INT, lines[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM base), range(1, len(lines) + 1) r(i)),
coded AS (SELECT units.*, ({_crc32("'L:' || doc_id || ':' || name")}) % 7 AS l, ({_crc32("'R:' || doc_id || ':' || name")}) % 7 AS r FROM units, crc),
rows_ AS (SELECT doc_id, l = 0 AS l_drop, r = 0 AS r_drop, l AS l_code, r AS r_code FROM coded WHERE kind = 0),
states AS (
  SELECT doc_id, kind, place, 0 AS slot, v AS b,
    CASE WHEN l = 0 AND kind = 2 THEN NULL WHEN l = 0 THEN '' WHEN l = 1 THEN v || '!' WHEN l = 2 THEN v || '?' ELSE v END AS x,
    CASE WHEN r = 0 AND kind = 2 THEN NULL WHEN r = 0 THEN '' WHEN r = 1 THEN v || '!' WHEN r = 2 THEN v || '?' ELSE v END AS y
  FROM coded WHERE kind > 0
  UNION ALL SELECT doc_id, kind, place, 1, NULL, CASE l WHEN 3 THEN '!' WHEN 4 THEN '?' END, CASE r WHEN 3 THEN '!' WHEN 4 THEN '?' END FROM coded WHERE kind = 2),
merged AS (SELECT *, x IS DISTINCT FROM b AS lc, y IS DISTINCT FROM b AS rc, x IS DISTINCT FROM y AS apart FROM states),
decided AS (SELECT m.*, CASE WHEN l_drop OR rc THEN y ELSE x END AS s, lc AND rc AND apart AS clash FROM merged m JOIN rows_ USING (doc_id)),
whole AS (
  SELECT doc_id, max(s) FILTER (kind = 1 AND place = 0) AS lang, max(s) FILTER (kind = 1 AND place = 1) AS source,
    coalesce(string_agg(s, chr(10) ORDER BY place, slot) FILTER (kind = 2 AND s IS NOT NULL), '') AS text, bool_or(lc) AS lc, bool_or(rc) AS rc,
    count(*) FILTER ((lc OR rc) AND NOT clash) AS n_clean, count(*) FILTER (clash AND slot = 0 AND x IS NOT NULL AND y IS NOT NULL) AS n_edit_edit,
    count(*) FILTER (clash AND slot = 0 AND (x IS NULL OR y IS NULL)) AS n_edit_delete, count(*) FILTER (clash AND slot = 1) AS n_insert_insert
  FROM decided GROUP BY doc_id),
kept AS (SELECT w.*, l_drop, r_drop, l_drop OR r_drop AS gone, (l_drop AND NOT r_drop AND rc) OR (r_drop AND NOT l_drop AND lc) AS lost FROM whole w JOIN rows_ USING (doc_id))
SELECT doc_id, CASE WHEN here THEN lang END AS lang, CASE WHEN here THEN source END AS source, CASE WHEN here THEN sha256(text) END AS text_sha256,
  CASE WHEN gone THEN (NOT lost)::BIGINT ELSE n_clean END AS n_clean, CASE WHEN gone THEN 0 ELSE n_edit_edit END AS n_edit_edit, CASE WHEN gone THEN lost::BIGINT ELSE n_edit_delete END AS n_edit_delete, CASE WHEN gone THEN 0 ELSE n_insert_insert END AS n_insert_insert
FROM (SELECT *, NOT gone OR (lost AND l_drop) AS here FROM kept)
UNION ALL
SELECT -1 - doc_id, lang, source, sha256(CASE WHEN r_code = 3 OR (r_code <> 4 AND l_code = 3) THEN '!' ELSE '?' END), CASE WHEN a AND b AND l_code <> r_code THEN 0 ELSE 1 END, 0, 0, CASE WHEN a AND b AND l_code <> r_code THEN 1 ELSE 0 END
FROM (SELECT *, l_code IN (3, 4) AS a, r_code IN (3, 4) AS b FROM rows_) JOIN base USING (doc_id) WHERE a OR b
"""
