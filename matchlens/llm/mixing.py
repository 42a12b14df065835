"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every source gets a target size by water-filling: weights share the whole size, no target passes
`limit` times its source's size, and what is cut off is shared again by weight. A document is to be
taken target / source size times on average. The whole part of that is certain; the fractional
parts are rounded in pairs: words move from one document to the other, in a random direction whose
odds keep every expectation, until one of the two is whole. Pairs meet in blocks of about BLOCK
documents of a source; the one document a block leaves undecided goes up a reduction tree with the
same fan-in, and the last one of a source is rounded by its own odds. So a source's taken words
differ from its target by less than the size of one document.

Defined results: null text has size 0 and is taken 0 words; documents without a source form a
source of their own, last in order; documents of size 0 take no part in the rounding; rows with the
same doc_id, source and size are one unit whose copies are dealt evenly over its rows; an empty
table gives no rows; other columns are not read. The draws are hashes of document ids, so that
reruns agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import numbered, staged, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
WHOLE = 1e-9
DRAW_BITS = 53


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): one row per source, weights repeating in code point order."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "__at")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = staged(per.withColumn("weight", F.element_at(cycle, (F.col("__at") % len(weights) + 1).cast("int"))).drop("__at"))
    most = F.col("source_size") * limit
    total = per.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, below = 0.0, -1
    while True:  # each round caps at least one more source, or is the last
        capped = F.col("weight") * F.lit(level) >= most
        r = per.agg(F.sum(F.when(capped, most)).alias("used"), F.sum(F.when(~capped, F.col("weight"))).alias("w"),
                    F.sum(capped.cast("long")).alias("n")).first()
        if not r["w"] or r["n"] == below:
            break
        below, level = r["n"], (total - (r["used"] or 0.0)) / r["w"]
    return per.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _pair(state: Column, unit: Column, seed: int) -> Column:
    """One step of the fold: the open document and the next one; at least one of them gets whole."""
    def settle(open_, u):
        a, b = open_["size"].cast("double"), u["size"].cast("double")
        up = F.least(a * (1 - open_["p"]), b * u["p"])      # words that can move to the open one
        down = F.least(a * open_["p"], b * (1 - u["p"]))
        draw = F.xxhash64(F.lit(seed), open_["doc_id"], u["doc_id"], open_["size"], u["size"]).bitwiseAND(
            F.lit((1 << DRAW_BITS) - 1)).cast("double") / float(1 << DRAW_BITS)
        moved = _let(F.struct(up.alias("up"), down.alias("down")), lambda m: F.when(
            draw * (m["up"] + m["down"]) < m["down"], m["up"]).otherwise(-m["down"]))
        return _let(moved, lambda d: F.struct(
            open_.withField("p", open_["p"] + d / a).alias("x"), u.withField("p", u["p"] - d / b).alias("y")))

    def whole(u):
        return (u["size"] <= 0) | (u["p"] <= WHOLE) | (u["p"] >= 1 - WHOLE)

    def both(done, x, y):
        ended = F.concat(F.filter(F.array(x, y), lambda u: whole(u)), done)
        left = F.filter(F.array(x, y), lambda u: ~whole(u))
        return F.struct(ended.alias("done"), left.alias("open"))

    fresh = F.struct(F.when(whole(unit), F.concat(state["done"], F.array(unit))).otherwise(state["done"]).alias("done"),
                     F.when(whole(unit), state["open"]).otherwise(F.array(unit)).alias("open"))
    paired = _let(settle(state["open"][0], unit), lambda r: both(state["done"], r["x"], r["y"]))
    return F.when((F.size(state["open"]) == 0) | whole(unit), F.when(
        F.size(state["open"]) == 0, fresh).otherwise(F.struct(
            F.concat(state["done"], F.array(unit)).alias("done"), state["open"].alias("open")))).otherwise(paired)


def rounded(units: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, n, copies, source_size, target) for units (doc_id, source, size, n):
    the copies that the n equal rows of a unit get together."""
    n = units.count()
    blocks = max(1, -(-n // BLOCK))
    kind = "array<struct<size:bigint,doc_id:bigint,n:bigint,base:bigint,p:double>>"
    key = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)).alias("block")
    level = units.groupBy("source", key).agg(
        F.sort_array(F.collect_list(F.struct("size", "doc_id", "n")), asc=False).alias("units"))
    same = level["source"].eqNullSafe(targets["source"])
    level = level.join(targets, same).select(level["source"], "block", "source_size", "target", "units")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)

    def started(u):
        all_ = F.round(u["n"] * F.col("ratio"), 9)
        return F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["n"].alias("n"),
                        F.floor(all_).alias("base"), (all_ - F.floor(all_)).alias("p"))
    level = level.withColumn("ratio", ratio).withColumn("units", F.transform("units", started).cast(kind)).drop("ratio")
    out = []
    while True:
        none = F.array().cast(kind)
        fold = F.aggregate("units", F.struct(none.alias("done"), none.alias("open")),
                           lambda s, u: _pair(s, u, seed).cast(f"struct<done:{kind},open:{kind}>"))
        level = staged(level.withColumn("r", fold).select(
            "source", "block", "source_size", "target", F.col("r.done").alias("done"), F.col("r.open").alias("open")))
        out.append(level.select("source", "source_size", "target", F.explode("done").alias("u")))
        if blocks == 1:
            break
        blocks = -(-blocks // BLOCK)
        level = level.where(F.size("open") > 0).groupBy(
            "source", F.floor(F.col("block") / BLOCK).alias("block"), "source_size", "target").agg(
                F.sort_array(F.flatten(F.collect_list("open")), asc=False).alias("units"))
    last = level.select("source", "source_size", "target", F.explode("open").alias("u"))
    draw = F.xxhash64(F.lit(seed), F.col("u.doc_id")).bitwiseAND(F.lit((1 << DRAW_BITS) - 1)) / float(1 << DRAW_BITS)
    out.append(last.withColumn("u", F.col("u").withField("p", (draw < F.col("u.p")).cast("double"))))
    all_ = out[0]
    for more in out[1:]:
        all_ = all_.unionByName(more)
    return all_.select("u.doc_id", "source", "u.size", "u.n", "source_size", "target",
                       (F.col("u.base") + (F.col("u.p") > 0.5).cast("long")).alias("copies"))


def decisions(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, seed: int = 0) -> DataFrame:
    """What `rounded` gives for the distinct (doc_id, source, size) of documents(doc_id, source, text)."""
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    units = staged(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))
    targets = staged(source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, limit))
    return rounded(units, targets, seed)


def _share(k: Column) -> Column:
    """Copies of the k-th (from 0) of n equal rows."""
    return F.floor(F.col("copies") / F.col("n")) + (k < F.col("copies") % F.col("n")).cast("long")


def mix(docs: DataFrame, **params) -> DataFrame:
    """docs, each row as often as the mix takes it."""
    d = decisions(docs, **params).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                                         F.col("size").alias("__size"), "n", "copies")
    d = d.select("__id", "__source", "__size", F.struct("n", "copies").alias("__mix"))
    key = n_words(F.col("text"))
    keyed = docs.withColumn("__n", key)
    joined = keyed.join(d, keyed["doc_id"].eqNullSafe(d["__id"]) & keyed["source"].eqNullSafe(d["__source"])
                        & (keyed["__n"] == d["__size"]))
    k = F.when(F.col("__mix.n") == 1, 0).otherwise(F.row_number().over(
        Window.partitionBy("__id", "__source", "__size").orderBy("text")) - 1)
    times = F.floor(F.col("__mix.copies") / F.col("__mix.n")) + (F.col("__k") < F.col("__mix.copies") % F.col("__mix.n")).cast("long")
    taken = joined.withColumn("__k", k).withColumn("__times", times).where("__times > 0")
    return taken.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op10: words taken from every document."""
    d = decisions(table(spark, sf_dir, "documents"))
    rows = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _share(F.col("k"))).alias("taken"))
