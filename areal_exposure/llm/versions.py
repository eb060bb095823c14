"""Fingerprints of texts that tell how much two versions share: invertible Bloom lookup tables of paragraphs.

A text's paragraphs (stretches up to a sentence's or line's end, at most 64 characters) are hashed; the k-th of
equal ones counts as its own. Each digest is added to one cell in each of four parts of a table, which keeps the
number of digests in a cell and the bits of digests and checks folded by exclusive or. Subtracting the tables of two
versions cancels what they share; cells left with one digest give it away, which clears it from its other cells, and
so on, until the differing digests are all known. Where cells remain, a larger table is tried. Everything is column
arithmetic and grouping, after one exchange of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areal_exposure.llm.common import whole_text
from areal_exposure.operators.joins import null_safe
from areal_exposure.sources.scratch import written

PARAGRAPH = r"[^\n.!?]{1,64}[\n.!?\s]*|[\n.!?\s]+"
PARTS = 4
#: Turns of peeling, one part of the table each. At the usual load a table is empty after about twelve.
TURNS = 16
_BLOCK_ROWS, _MOST_BLOCKS = 512, 1 << 16
# Rows of a pair's table beside its cells, and kinds of tables.
_ROOT, _MINE, _THEIRS = -1, -2, -3
_OWN, _EDITED, _TO_EDITED, _TO_NEXT = range(4)


def digests(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter of code points replaced by as many of the following one's first (or all)."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def with_next(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with ``following``, the text after it by doc_id (then text), and a key grp, row.

    After the last comes the first. Rows are dealt to at most 65,536 ranges of doc_id; each range also gets the
    first document of the range after it, so that no row needs another range. A null doc_id counts as the least.
    ``only`` has the ranges (grp) that are wanted, if not all are.
    """
    ends = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low = ends["low"] or 0
    ranges = max(1, min(_MOST_BLOCKS, ends["n"] // _BLOCK_ROWS))
    width = max(1, -(-((ends["high"] or 0) - low + 1) // ranges))
    place = F.coalesce("doc_id", F.lit(low).cast("long"))
    grp = F.floor((place - low) / width).cast("int")
    firsts = docs.select(place.alias("first"), grp.alias("grp")).groupBy("grp").agg(F.min("first").alias("first"))
    # One row per range, so few enough for one task and for every task.
    by_range = Window.orderBy("grp")
    before = F.coalesce(F.lag("grp").over(by_range), F.max("grp").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select("first", before.alias("before"))
    rows = docs.select("doc_id", "text", place.alias("place"), grp.alias("grp"))
    rows = rows.join(F.broadcast(firsts), F.col("place") == F.col("first"), "left")
    own = F.struct(F.col("grp").alias("grp"), F.lit(False).alias("extra"))
    extra = F.struct(F.col("before").alias("grp"), F.lit(True).alias("extra"))
    homes = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, extra))
    rows = rows.select("doc_id", "text", "place", F.explode(homes).alias("home")).select("doc_id", "text", "place", "home.*")
    if only is not None:  # at most a row per range
        rows = rows.join(F.broadcast(only.select("grp").distinct()), "grp", "left_semi")
    # Two ranges a task: a task's tables then fit in memory without spilling, however many documents there are.
    rows = rows.repartition(max(1, ranges // 2), "grp")
    order = Window.partitionBy("grp").orderBy("extra", "place", "doc_id", "text")
    rows = rows.withColumn("following", F.lead("text").over(order)).withColumn("row", F.row_number().over(order))
    return rows.where(~F.col("extra")).select("doc_id", "text", "following", "grp", "row")


def cell_entries(pairs: DataFrame, factor: float) -> DataFrame:
    """``pairs`` (grp, row, own, edited, following: arrays of digests) as the cells of their tables.

    Columns grp, row, size (cells in a part), cell, and of each version n, key and check.
    """
    most = F.size("own") + F.greatest(F.size("edited"), F.size("following"))
    pairs = pairs.withColumn("size", F.ceil(most * factor / PARTS).cast("int") + 6)
    sides = F.array(*(F.struct(F.lit(v).alias("v"), F.col(c).alias("held")) for v, c in enumerate(("own", "edited", "following"))))
    rows = pairs.select("grp", "row", "size", F.explode(sides).alias("s")).select("grp", "row", "size", "s.v", F.explode("s.held").alias("digest"))
    rows = rows.groupBy("grp", "row", "size", "v", "digest").agg(F.count("*").cast("int").alias("times"))
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    rows = rows.select("grp", "row", "size", "v", F.xxhash64("digest", "nth").alias("key"))
    rows = rows.select("*", _check("key").alias("check"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
    rows = rows.withColumn("cell", _cell("key", F.col("part"), "size"))
    kept = []
    for v, name in enumerate("aen"):
        mine = F.col("v") == v
        kept += [F.count(F.when(mine, 1)).cast("int").alias(f"n_{name}")]
        kept += [F.coalesce(F.bit_xor(F.when(mine, F.col(c))), F.lit(0).cast("long")).alias(f"{c}_{name}") for c in ("key", "check")]
    return rows.groupBy("grp", "row", "size", "cell").agg(*kept)


def _check(key: str) -> Column:
    return F.xxhash64(F.lit(77), key)


def _cell(key: str, part: Column, size: str) -> Column:
    return part * F.col(size) + F.pmod(F.xxhash64(part, key), F.col(size)).cast("int")


def differences(cells: DataFrame) -> DataFrame:
    """The tables of own less edited and own less following text, and the roots of own and edited.

    A root is the sum of all cells of one part, whatever the table's size. Columns grp, row, size, kind, cell, n,
    key, check.
    """
    def row(kind: int, cell: Column, n: Column, key: Column, check: Column) -> Column:
        parts = (F.lit(kind).alias("kind"), cell.alias("cell"), n.alias("n"), key.alias("key"), check.alias("check"))
        return F.struct(*parts)

    c, root = F.col, F.lit(_ROOT)
    out = [
        row(_OWN, root, c("n_a"), c("key_a"), c("check_a")),
        row(_EDITED, root, c("n_e"), c("key_e"), c("check_e")),
        *(
            row(kind, c("cell"), c("n_a") - c(f"n_{o}"), c("key_a").bitwiseXOR(c(f"key_{o}")), c("check_a").bitwiseXOR(c(f"check_{o}")))
            for kind, o in ((_TO_EDITED, "e"), (_TO_NEXT, "n"))
        ),
    ]
    rows = cells.select("grp", "row", "size", "cell", F.explode(F.array(*out)).alias("t"))
    rows = rows.where((F.col("t.kind") > _EDITED) | (F.col("cell") < F.col("size")))
    rows = rows.where((F.col("t.n") != 0) | (F.col("t.key") != 0)).select("grp", "row", "size", "t.*")
    return _summed(rows)


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("grp", "row", "size", "kind", "cell").agg(
        F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check")
    )
    return out.where((F.col("n") != 0) | (F.col("key") != 0))


def peeled_once(rows: DataFrame, part: int) -> DataFrame:
    """Take the digests that stand alone in a cell of this part out of their other cells, and count them.

    Within one part a digest has one cell, so none is taken out twice.
    """
    low, high = F.col("size") * part, F.col("size") * (part + 1)
    alone = (F.abs("n") == 1) & (F.col("cell") >= low) & (F.col("cell") < high) & (F.col("check") == _check("key"))

    def row(cell: Column, n: Column, *rest: Column) -> Column:
        key, check = rest or (F.col("key"), F.col("check"))
        return F.struct(cell.alias("cell"), n.cast("int").alias("n"), key.alias("key"), check.alias("check"))

    nothing = F.lit(0).cast("long")
    others = [row(_cell("key", F.lit(p), "size"), -F.col("n")) for p in range(PARTS) if p != part]
    known = row(F.when(F.col("n") > 0, _MINE).otherwise(_THEIRS), F.lit(1), nothing, nothing)
    out = F.when(alone, F.array(*others, known)).otherwise(F.array(row(F.col("cell"), F.col("n"))))
    return _summed(rows.select("grp", "row", "size", "kind", F.explode(out).alias("t")).select("grp", "row", "size", "kind", "t.*"))


def peeled(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """grp, row, and: own_root, edited_root (n, key, check), and of both differences mine, theirs and the cells left."""
    for turn in range(turns):
        rows = peeled_once(rows, turn % PARTS)
    c = F.col

    def at(kind: int, cell: int, value: str) -> Column:
        return F.coalesce(F.max(F.when((c("kind") == kind) & (c("cell") == cell), c(value))), F.lit(0).cast("long"))

    out = []
    for kind, name in ((_OWN, "own"), (_EDITED, "edited")):
        out += [at(kind, _ROOT, v).alias(f"{name}_{v}") for v in ("n", "key", "check")]
    for kind, name in ((_TO_EDITED, "edited"), (_TO_NEXT, "next")):
        out += [at(kind, _MINE, "n").alias(f"mine_{name}"), at(kind, _THEIRS, "n").alias(f"theirs_{name}")]
        out += [F.count(F.when((c("kind") == kind) & (c("cell") >= 0), 1)).alias(f"left_{name}")]
    return rows.groupBy("grp", "row").agg(*out)


def _compared(pairs: DataFrame, factor: float) -> DataFrame:
    return peeled(differences(cell_entries(pairs, factor)))


def _told(docs: DataFrame, factor: float, bad: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` (or those of ``bad``, by grp and row) with what its tables tell; the texts move once."""
    rows = with_next(docs, bad)
    if bad is not None:
        rows = rows.join(bad, ["grp", "row"], "left_semi")
    after = rows.withColumn("edited", edited(F.col("text"), F.col("following")))
    arrays = [digests(F.col(c)).alias(n) for c, n in (("text", "own"), ("edited", "edited"), ("following", "following"))]
    found = _compared(after.select("grp", "row", *arrays), factor)
    values = [c for c in found.columns if c not in ("grp", "row")]
    digest = F.sha2("edited", 256).alias("edited_sha256")
    about = after.select("doc_id", "grp", "row", F.char_length("text").cast("long").alias("n_chars"), digest)
    # Not a plain equality: that filters nulls before the exchange of the texts on one side only, and they move twice.
    # A pair without any paragraph has no table: all of its numbers are 0.
    return null_safe(about, found, ["grp", "row"], "left").fillna(0, values)


def _likeness(other: str) -> Column:
    """Common paragraphs as a share of both versions' mean number, from the numbers of differing ones."""
    common = F.col("own_n") - F.col(f"mine_{other}")
    both = F.col("own_n") + common + F.col(f"theirs_{other}")
    return F.when(both == 0, 1.0).otherwise(2 * common / both)


def _fingerprint(name: str) -> Column:
    return F.concat_ws("-", F.col(f"{name}_n").cast("string"), F.lower(F.lpad(F.hex(f"{name}_key"), 16, "0")), F.lower(F.lpad(F.hex(f"{name}_check"), 16, "0")))


def fingerprints(docs: DataFrame, factor: float = 1.7) -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is ``edited`` with the next document's text, by doc_id and then text. A fingerprint is the root
    of a text's table, so equal texts have equal ones; the likenesses (0 to 1, twice the common paragraphs by all) come
    from the full tables, which have ``factor`` cells for each paragraph of both versions and are doubled until
    every difference is recovered. A null or empty text has no paragraphs, and two such are alike (1); an empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    out = written(_told(docs, factor), "versions")
    failed = (F.col("left_edited") > 0) | (F.col("left_next") > 0)
    while not out.where(failed).isEmpty():
        factor *= 2
        bad = out.where(failed).select("grp", "row")
        again = _told(docs, factor, bad)
        out = written(out.where(~failed).union(again), "versions")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", _fingerprint("own").alias("fingerprint"), _fingerprint("edited").alias("edited_fingerprint"),
        _likeness("edited").alias("near_edited"), _likeness("next").alias("near_next"),
    )
