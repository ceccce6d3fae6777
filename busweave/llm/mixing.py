"""Mixing sources to target weights in blocks of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from busweave.llm.common import WORD
from busweave.session import checkpointed

#: Words per block, slots per output shard, rounds of the index permutation, rows per slice of a source.
BLOCK, SHARD, ROUNDS, SLICE = 128, 8192, 12, 20_000
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """Uniform long below 2^60 that depends on ``parts`` alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 4)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """One row per source: sid (order by code point, null last), source_size, target, n_blocks, quota in blocks.

    Targets follow the weights and stop at ``MOST`` times the source; what is cut off goes to the others by weight
    until none is above. That is one level for all uncapped sources: capping in order of size per weight, a source
    is capped if the level that all later sources would get still lies above it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("sid", F.row_number().over(by_name).cast("long") - 1).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", MOST * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    wanted = share * F.sum("source_size").over(Window.partitionBy())
    ranked = ranked.withColumn("level", (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    open_ = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", "level")))
    ranked = ranked.withColumn("level", open_.over(Window.partitionBy())["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")), MOST * F.col("n_blocks"))).otherwise(0)
    return (
        ranked.withColumn("target", target)
        .withColumn("n_blocks", blocks.cast("long"))
        .withColumn("quota", quota.cast("long"))
        .select("source", "sid", "source_size", "target", "n_blocks", "quota")
    )


def lay_out(sized: DataFrame, targets: DataFrame, id_col: str) -> DataFrame:
    """``sized`` with sid and ``start``: each row's first word in the stream of its source.

    Running sums go inside hash slices of a source; the slices' own totals are summed first. A source with a third of
    all rows is spread over its slices.
    """
    slices = max(1, -(-sized.count() // SLICE))
    keyed = sized.join(targets.select(F.col("source").alias("__s"), "sid"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64(id_col), F.lit(slices)))
    sums = keyed.groupBy("sid", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "slice", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "slice").orderBy(id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(sums, ["sid", "slice"]).withColumn("start", F.col("base") + F.col("inside")).drop("slice", "base", "inside")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not): in each round an index and its mirror swap or stay together."""

    def step(x: Column, r: Column) -> Column:
        mirror = F.pmod(draw(r, F.lit("k"), *key) - x, n)
        swap = F.bit_get(draw(r, F.greatest(x, mirror), *key), F.lit(0)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def draw_slots(targets: DataFrame, seed: int) -> DataFrame:
    """``(shard, slot, sid, block)``: which block of which source fills each output slot.

    Every slot draws its source, so that a shard's counts per source are multinomial. Slots that a source drew beyond
    its quota are dealt to the sources below theirs, which makes the totals exact. The j-th slot of a source reads
    block ``permutation(j mod n_blocks)``: no block is read twice before all have been read once.
    """
    spark = targets.sparkSession
    total = targets.agg(F.sum("quota")).first()[0] or 0
    width = max(1, -(-total // BINS))
    shelf = targets.withColumn("hi", F.sum("quota").over(Window.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("quota"))
    shelf = shelf.where("quota > 0").select(
        "sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bin")
    )
    slots = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod("id", F.lit(SHARD)).alias("slot"))
    slots = slots.withColumn("u", F.pmod(draw(F.lit(seed), F.col("shard"), F.col("slot")), F.lit(max(1, total))))
    slots = slots.withColumn("bin", F.floor(F.col("u") / width)).join(shelf, "bin").where("u >= lo AND u < hi")
    slots = checkpointed(slots.select("shard", "slot", "sid"), "slots")
    counts = slots.groupBy("shard", "sid").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("shard", "sid").orderBy("slot")) - 1
    ranked = slots.withColumn("nth", nth).join(counts.select("shard", "sid", "ahead"), ["shard", "sid"])
    ranked = ranked.withColumn("j", F.col("ahead") + F.col("nth"))
    drawn = targets.join(counts.groupBy("sid").agg(F.sum("n").alias("drawn")), "sid", "left").fillna(0, ["drawn"])
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    sources = drawn.select(
        "sid",
        "quota",
        "n_blocks",
        "drawn",
        F.coalesce(F.sum(F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).over(by_sid), F.lit(0)).alias("over_ahead"),
        F.coalesce(F.sum(F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))).over(by_sid), F.lit(0)).alias("short_ahead"),
    )
    ranked = ranked.join(sources.select("sid", "quota", "over_ahead", "n_blocks"), "sid")
    short = sources.where("quota > drawn").select(
        F.col("sid").alias("to"), "n_blocks", F.posexplode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("at", "j"), "short_ahead"
    )
    short = short.select("to", "n_blocks", "j", (F.col("at") + F.col("short_ahead")).alias("nr"))
    moved = ranked.where("j >= quota").select("shard", "slot", (F.col("over_ahead") + F.col("j") - F.col("quota")).alias("nr"))
    moved = moved.join(short, "nr").select("shard", "slot", F.col("to").alias("sid"), "n_blocks", "j")
    dealt = ranked.where("j < quota").select("shard", "slot", "sid", "n_blocks", "j").unionByName(moved)
    block = permuted(F.pmod("j", F.col("n_blocks")), F.col("n_blocks"), F.lit(seed), F.col("sid"))
    return dealt.select("shard", "slot", "sid", block.alias("block"))


def mix(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, laid-out rows and fragments of the mix.

    The rows are ``docs`` with size, sid and start. A fragment ``(sid, start, block, begin, words, times)`` says that
    ``words`` words of the row at (sid, start), from its word ``begin`` on, are read ``times`` times as part of that
    block; slots of the same block share it. Null and wordless texts have size zero and no fragment. Rows with equal
    ids are separate rows. The result depends on ids, sizes, sources and the seed, not on partitioning.
    """
    sized = docs.withColumn("size", word_count(F.col(text_col))) if "size" not in docs.columns else docs
    sized = sized if source_col == "source" else sized.withColumn("source", F.col(source_col))
    targets = checkpointed(source_targets(sized), "targets")
    rows = checkpointed(lay_out(sized, targets, id_col), "layout")
    uses = draw_slots(targets, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK)
    pieces = rows.where("size > 0").select("sid", "start", end.alias("end"), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * BLOCK)
    pieces = pieces.select(
        "sid",
        "start",
        "block",
        (begin - F.col("start")).alias("begin"),
        (F.least("end", (F.col("block") + 1) * BLOCK) - begin).alias("words"),
    )
    return targets, rows, pieces.join(uses, ["sid", "block"])


def mixed_counts(docs: DataFrame, seed: int = 1) -> DataFrame:
    """Per row of ``docs (doc_id, text, source)``: size, source_size, target and taken words."""
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets, rows, fragments = mix(slim, seed)
    taken = fragments.groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = rows.join(targets.select("sid", "source_size", "target"), "sid")
    hit = out.where("size > 0").join(taken, ["sid", "start"], "left")
    out = hit.unionByName(out.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mix as rows of ``docs``: a row for each pass over a document, holding the words that the pass takes.

    A pass that takes every word keeps the text as it is, another one joins its words by one space. n_chars follows.
    """
    _, rows, fragments = mix(docs.drop("size", "sid", "start"), seed)
    spans = fragments.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"))
    spans = spans.groupBy("sid", "start", "pass").agg(F.sum("words").alias("got"), F.collect_list(F.struct("begin", "words")).alias("spans"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(
        F.flatten(F.transform(F.array_sort("spans"), lambda s: F.slice("all", (s["begin"] + 1).cast("int"), s["words"].cast("int")))), " "
    )
    joined = rows.where("size > 0").join(spans, ["sid", "start"]).withColumn("all", F.when(F.col("got") < F.col("size"), words))
    text = F.when(F.col("got") < F.col("size"), cut).otherwise(F.col("text"))
    joined = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
