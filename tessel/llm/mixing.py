"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks (DataFrame functions only).

Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.  A source's target is its weight's share of
``share`` times all words, stopped at ``max_repeat`` times the source's own words; the excess is dealt
again by weight until no source is above (in closed form: sources in order of limit over weight).

Blocks of equal size are allocated to sources by highest quotients target / (2k + 1).  A block has ``block`` words, fewer where the
smallest target would not hold ``parts`` blocks, so small sources come near their targets too.  What a quota has above its
source's limit is dealt again, a word at a time, to the sources that are furthest below their targets.  A source's words are allocated to its
shards by highest quotients of their words, before any document is chosen; then no shard is above ``max_repeat`` times its words.
A shard lays its documents out in seeded order as one stream of words.  Of a quota T over W words it takes the whole
stream T div W times and, of the rest, runs of ``run`` words spread evenly from a seeded offset; the last run is cut so that
the quota is met to the word.

No text passes a window: places are found on rows of two hashes and a size, and ``readings`` joins them back to the texts.
About the square root of a source's documents are one shard, so neither a shard nor the shards of a source outgrow a task.

Defined results: empty or null texts have size 0 and are taken 0 times; null is a source (the last one);
repeated rows are separate documents, and those equal in every column are interchangeable, so reruns agree; an empty table gives an empty
result; ``mix`` returns its own columns only, whatever other columns ``docs`` has, and ``readings`` returns exactly the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .util import WORD, hold

WEIGHTS = (3, 1, 2)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, share_num: int = 3, share_den: int = 2, max_repeat: int = 2) -> DataFrame:
    """(source, source_size, docs) to (…, target).  One row per source: the whole-table windows see no documents."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(x).cast("double") for x in weights]), (F.pmod(F.col("_mx_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_mx_i", F.row_number().over(order)).withColumn("_mx_w", w)
    s = s.withColumn("_mx_cap", F.lit(float(max_repeat)) * F.col("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("_mx_all", F.sum("source_size").over(everything) * F.lit(share_num / share_den))
    s = s.withColumn("_mx_wall", F.sum("_mx_w").over(everything))
    filled = Window.orderBy(F.col("_mx_cap") / F.col("_mx_w"), "_mx_i").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_mx_c0", F.coalesce(F.sum("_mx_cap").over(filled), F.lit(0.0)))
    s = s.withColumn("_mx_w0", F.coalesce(F.sum("_mx_w").over(filled), F.lit(0.0)))
    level = (F.col("_mx_all") - F.col("_mx_c0")) / (F.col("_mx_wall") - F.col("_mx_w0"))
    s = s.withColumn("_mx_full", F.col("_mx_cap") <= F.col("_mx_w") * level)
    free = F.max(F.when(~F.col("_mx_full"), level)).over(everything)  # the first that is not full has the highest
    s = s.withColumn("target", F.when(F.col("_mx_full"), F.col("_mx_cap")).otherwise(F.col("_mx_w") * free))
    return s.withColumn("target", F.least("target", "_mx_cap"))


def apportion(rows: DataFrame, keys: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Sainte-Lague: deal ``seats`` (same for all rows of ``keys``) to rows by highest quotient of ``votes``; adds ``quota``.

    A row's seats differ from its ideal share s by at most 1/2 + s / (2 mean s): rounding all shares moves the
    common divisor by no more than that.  So only quotients inside that band are ranked, about five a row, and
    what lies below the band is certain.
    """
    group = Window.partitionBy(*keys)
    total, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    r = rows.withColumn("_mx_s", F.when(total > 0, F.col(votes) * F.col(seats) / total).otherwise(0.0)).withColumn("_mx_n", n)
    band = F.lit(0.5) + F.when(F.col(seats) > 0, F.col("_mx_s") * F.col("_mx_n") / (2 * F.col(seats))).otherwise(0.0)
    r = r.withColumn("_mx_low", F.greatest(F.floor(F.col("_mx_s") - band) - 1, F.lit(0)))
    r = r.withColumn("_mx_high", F.when((F.col(seats) > 0) & (F.col(votes) > 0), F.ceil(F.col("_mx_s") + band) + 1).otherwise(F.col("_mx_low")))
    r = r.withColumn("_mx_rest", F.col(seats) - F.sum("_mx_low").over(group))
    c = r.withColumn("_mx_k", F.explode_outer(F.when(F.col("_mx_high") > F.col("_mx_low"), F.sequence("_mx_low", F.col("_mx_high") - 1))))
    quotient = F.col(votes) / (2 * F.col("_mx_k") + 1)
    c = c.withColumn("_mx_r", F.row_number().over(group.orderBy(F.col("_mx_k").isNull(), quotient.desc(), *order)))
    won = F.sum(F.when(F.col("_mx_k").isNotNull() & (F.col("_mx_r") <= F.col("_mx_rest")), 1).otherwise(0))
    names = rows.columns
    return c.groupBy(*names, "_mx_low").agg(won.alias("_mx_won")).select(*names, (F.col("_mx_low") + F.col("_mx_won")).cast("long").alias("quota"))


def source_quotas(sources: DataFrame, block: int, parts: int, max_repeat: int) -> DataFrame:
    """(source, source_size, target, _mx_i and more) with ``_mx_sq``, the words that each source gives."""
    everything = Window.partitionBy()
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    s = sources.withColumn("_mx_block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block), F.floor(least / parts))), F.lit(1)).cast("long"))
    s = s.withColumn("_mx_seats", F.round(F.sum("target").over(everything) / F.col("_mx_block")).cast("long")).withColumn("_mx_one", F.lit(0))
    s = apportion(s, ["_mx_one"], "target", "_mx_seats", ["_mx_i"])
    s = s.withColumn("_mx_dealt", F.col("quota") * F.col("_mx_block")).withColumn("_mx_top", F.col("source_size") * max_repeat)
    s = s.withColumn("_mx_sq", F.least("_mx_dealt", "_mx_top"))
    over = F.sum(F.col("_mx_dealt") - F.col("_mx_sq")).over(everything)
    # a source takes of the excess what lies between it and its target, those furthest below first
    short = F.greatest(F.lit(0), F.least(F.ceil(F.col("target")), F.col("_mx_top")) - F.col("_mx_sq")).cast("long")
    s = s.withColumn("_mx_over", over).withColumn("_mx_short", short)
    before = F.coalesce(F.sum("_mx_short").over(Window.orderBy(F.col("_mx_short").desc(), "_mx_i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = s.withColumn("_mx_sq", F.col("_mx_sq") + F.greatest(F.lit(0), F.least("_mx_short", F.col("_mx_over") - before)))
    return s.drop("_mx_block", "_mx_seats", "_mx_one", "quota", "_mx_dealt", "_mx_top", "_mx_over", "_mx_short")


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``_mx_h`` and ``_mx_g``: 128 bits of hashes of all columns."""
    whole = [F.to_json(f.name) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name) for f in docs.schema.fields]
    return docs.withColumns({"_mx_h": F.xxhash64(F.lit(seed), *whole), "_mx_g": F.xxhash64(F.lit(seed + 1), *whole)})


def mix(docs: DataFrame, weights=WEIGHTS, share: tuple[int, int] = (3, 2), max_repeat: int = 2, block: int = 32, parts: int = 8, run: int = 32, shard_docs: int = 64, seed: int = 17) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text, source and more): doc_id, source, ``size``, ``source_size``, ``target``, ``taken``.

    Further columns tell ``readings`` what is taken: the row's key (_mx_h, _mx_g), _mx_from (place of its first word in the shard's stream), _mx_whole (times that
    the whole stream is taken), and of the rest _mx_n (runs in the stream), _mx_p (runs taken), _mx_o (offset), _mx_last and _mx_rem (the run that is cut, and its words).
    """
    slim = keyed(docs, seed).select("doc_id", "source", "_mx_h", "_mx_g", words_in(F.col("text")).alias("size"))
    slim = hold(slim)
    src = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_mx_docs"))
    src = source_quotas(targets(src, weights, *share, max_repeat).select("source", "source_size", "target", "_mx_docs", "_mx_i"), block, parts, max_repeat)
    of_shard = F.greatest(F.lit(shard_docs), F.ceil(F.sqrt("_mx_docs")))
    src = hold(src.withColumn("_mx_shards", F.ceil(F.col("_mx_docs") / of_shard)).drop("_mx_docs"))
    if src.count() <= 20_000:
        joined = slim.join(F.broadcast(src.withColumnRenamed("source", "_mx_src")), F.col("source").eqNullSafe(F.col("_mx_src")))
    else:  # more sources than a broadcast may hold: salted keys, so that a source with a third of all rows is split
        salt = 64
        spread = src.withColumnRenamed("source", "_mx_src").withColumn("_mx_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        joined = slim.withColumn("_mx_t", F.pmod("_mx_h", F.lit(salt)).cast("int")).join(spread, F.col("source").eqNullSafe(F.col("_mx_src")) & (F.col("_mx_t") == F.col("_mx_salt"))).drop("_mx_t", "_mx_salt")
    joined = joined.drop("_mx_src").withColumn("_mx_shard", F.pmod(F.xxhash64("_mx_h", F.lit(1)), "_mx_shards"))
    shards = joined.groupBy("_mx_i", "_mx_shard").agg(F.sum("size").alias("_mx_w"), F.first("_mx_sq").alias("_mx_sq"))
    shards = apportion(shards, ["_mx_i"], "_mx_w", "_mx_sq", ["_mx_shard"])
    rest = F.expr("if(_mx_w = 0, 0, quota % _mx_w)")
    shards = shards.select(F.col("_mx_i").alias("_mx_i2"), F.col("_mx_shard").alias("_mx_shard2"), "_mx_w", F.expr("if(_mx_w = 0, 0, quota div _mx_w)").alias("_mx_whole"), rest.alias("_mx_rest"))
    shards = shards.withColumn("_mx_p", F.expr(f"(_mx_rest + {run - 1}) div {run}"))
    shards = shards.withColumn("_mx_n", F.expr(f"greatest(_mx_p, _mx_w div {run})"))  # only whole runs, unless all are taken and some of the tail
    shards = shards.withColumn("_mx_rem", F.expr(f"_mx_rest - (_mx_p - 1) * {run}"))
    shards = shards.withColumn("_mx_o", F.when(F.col("_mx_n") > 0, F.pmod(F.xxhash64("_mx_i2", "_mx_shard2", F.lit(seed)), F.greatest("_mx_n", F.lit(1)))).otherwise(0).cast("long"))
    shards = shards.withColumn("_mx_last", F.expr("if(_mx_p = 0, -1, (_mx_p * _mx_n - _mx_o + _mx_p - 1) div _mx_p - 1)"))
    placed = joined.join(shards, (F.col("_mx_i") == F.col("_mx_i2")) & (F.col("_mx_shard") == F.col("_mx_shard2")))
    stream = Window.partitionBy("_mx_i", "_mx_shard").orderBy("_mx_h", "_mx_g").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_mx_from", F.coalesce(F.sum("size").over(stream), F.lit(0).cast("long")))
    taken = F.col("_mx_whole") * F.col("size") + rest_before(F.col("_mx_from") + F.col("size"), run) - rest_before(F.col("_mx_from"), run)
    placed = placed.withColumn("taken", F.when(F.col("size") > 0, taken).otherwise(0).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "taken", "_mx_h", "_mx_g", "_mx_from", "_mx_whole", "_mx_n", "_mx_p", "_mx_o", "_mx_last", "_mx_rem")


def runs_before(b: Column) -> Column:
    """How many of the first b runs of a stream are taken: the steps of an even spread of _mx_p over _mx_n."""
    return F.when(F.col("_mx_p") == 0, 0).otherwise(F.floor((b * F.col("_mx_p") + F.col("_mx_o")) / F.greatest("_mx_n", F.lit(1)))).cast("long")


def words_of_run(b: Column, run: int) -> Column:
    """Words that the rest of the quota takes of run b."""
    return F.when(b == F.col("_mx_last"), F.col("_mx_rem")).when(b > F.col("_mx_last"), 0).otherwise((runs_before(b + 1) - runs_before(b)) * run).cast("long")


def rest_before(x: Column, run: int) -> Column:
    """Words that the rest of the quota takes of the first x words of the stream."""
    b = F.floor(x / F.lit(run)).cast("long")
    last = F.col("_mx_last")
    before = F.when(b > last, F.greatest(F.lit(0), (F.col("_mx_p") - 1) * run + F.col("_mx_rem"))).otherwise(runs_before(b) * run)
    return F.when(F.col("_mx_p") == 0, 0).otherwise(before + F.least(x - b * run, words_of_run(b, run))).cast("long")


def readings(docs: DataFrame, mixed: DataFrame, run: int = 32, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each reading of a document, its ``text`` the words that this reading takes.

    Where a reading takes all words the text is unchanged; else runs of taken words are joined by one space.  ``mixed``: what ``mix`` made of
    ``docs`` with this ``run`` and ``seed``.  Rows equal in all columns meet their places as one text, so that join makes no pairs.
    """
    one = F.first(F.struct(*docs.columns)).alias("_mx_doc")
    texts = keyed(docs, seed).groupBy("_mx_h", "_mx_g").agg(one)
    part = rest_before(F.col("_mx_from") + F.col("size"), run) - rest_before(F.col("_mx_from"), run)
    m = mixed.where("taken > 0").withColumn("_mx_part", part)
    m = m.select("_mx_h", "_mx_g", *[c for c in m.columns if c.startswith("_mx_") and c not in ("_mx_h", "_mx_g")], F.col("size").alias("_mx_size"))
    r = m.join(texts, ["_mx_h", "_mx_g"])
    r = r.withColumn("_mx_reading", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mx_whole") + (F.col("_mx_part") > 0).cast("long"))))
    start, end = F.col("_mx_from"), F.col("_mx_from") + F.col("_mx_size")
    runs = F.sequence(F.floor(start / run).cast("long"), F.floor((end - 1) / run).cast("long"))
    lo = lambda b: F.greatest(b * run - start, F.lit(0).cast("long"))
    hi = lambda b: F.least(b * run + words_of_run(b, run) - start, F.col("_mx_size"))
    cut = F.filter(F.transform(runs, lambda b: F.struct(lo(b).cast("int").alias("lo"), hi(b).cast("int").alias("hi"))), lambda x: x["hi"] > x["lo"])
    word = F.regexp_extract_all(F.col("_mx_doc.text"), F.lit(f"({WORD})"), F.lit(1))
    some = F.transform(F.array(word), lambda ws: F.array_join(F.flatten(F.transform(cut, lambda x: F.slice(ws, x["lo"] + 1, x["hi"] - x["lo"]))), " "))[0]  # the words are bound once, not extracted for every run
    whole = (F.col("_mx_reading") <= F.col("_mx_whole")) | (F.col("_mx_part") == F.col("_mx_size"))
    text = F.when(whole, F.col("_mx_doc.text")).otherwise(some)
    return r.select(*[text.alias(c) if c == "text" else F.col("_mx_doc")[c].alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
