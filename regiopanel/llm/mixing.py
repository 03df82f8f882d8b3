r"""Operator 9: mixing sources to target weights by temperature. DataFrame functions only.

Sources have shares of all tokens. Raised to an exponent and normalised, the shares are the target weights: exponent 1
leaves them, 0 makes them equal. The exponent is bisected (``SECTIONS`` parts at a time, each round one aggregate over the
sources) until the mixture has a wanted entropy, or is the flattest one that repeats no source more than a limit.

Weights are realised as budgeted block permutations. A source's documents fall by hash into blocks of about ``BLOCK``,
blocks into groups of ``BLOCK``. In each epoch the groups, the blocks in a group and the documents in a block are put in an
order by keyed hash; a document's position is the number of tokens before it. An epoch's documents are taken up
to the source's budget, so whole epochs repeat a source and the last one is cut. No source is sorted in one task:
positions add up running sums over the groups of a source, the blocks of a group and the documents of a block.
Rows before the windows carry ids and counts only, and the few rows of the source plan are read from a small table.

Tokens are words (runs other than 0x20 and 0x09 to 0x0D).

Defined results: a null source is a source of its own. A source without tokens costs nothing: its documents, like all those
without tokens at the cut, come once. Null and empty texts have no tokens. Repeated rows are rows of their own, in the
same place of the order. A null id sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regiopanel.session import materialize

#: Documents of a block and blocks of a group; parts of the exponent's interval in a round, rounds, and the key of the order.
BLOCK, SECTIONS, ROUNDS, SEED = 1000, 32, 5, "mix"
#: A document's words.
WORD = r"[^\x20\x09-\x0D]+"
#: Where between the entropy of the shares and that of equal weights the mixture of the query lies.
EVENNESS = 0.5
#: The most epochs of a source in the pipeline, where every document comes at least once.
REPEATS = 1.5


def source_totals(rows: DataFrame) -> DataFrame:
    """``source, tokens, docs`` of rows with ``source`` and ``n_tokens``."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))


def mixture(share: list[float], exponent: float) -> list[float]:
    """Weights of shares (for tests and small uses; the operator computes them in Spark)."""
    raised = [p ** exponent for p in share]
    return [r / sum(raised) for r in raised]


def bisect_exponent(sources: DataFrame, total: int, evenness: float | None, repeats: float | None, budget: int | None) -> float:
    """The exponent in 0..1, to six decimals: of the wanted entropy, or the least whose repetition is within the limit."""
    p = F.col("tokens") / F.lit(float(total))
    shares = sources.where("tokens > 0").select(p.alias("p"))

    def measure(grid: list[float]) -> list[tuple]:
        t = F.col("t")
        rows = shares.select("p", F.explode(F.array(*map(F.lit, grid))).alias("t")).groupBy("t").agg(
            F.sum(F.pow("p", t)).alias("z"), F.sum(F.pow("p", t) * F.log("p")).alias("a"), F.min("p").alias("lo"), F.max("p").alias("hi"))
        entropy = F.log("z") - t * F.col("a") / F.col("z")
        most = F.pow("lo", t - 1)  # tokens wanted by those there are, of the source that is repeated most
        epochs = most / F.pow("hi", t - 1) if budget is None else most / F.col("z") * (budget / total)
        return [tuple(r) for r in rows.select("t", entropy, epochs).orderBy("t").collect()]

    low, high = 0.0, 1.0
    (_, even, _), (_, natural, least) = measure([low, high])
    wanted = natural + evenness * (even - natural) if evenness is not None else None
    if wanted is None and least > repeats:
        return 1.0  # even the shares as they are exceed the limit
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / SECTIONS for i in range(SECTIONS + 1)]
        # Both measures fall as the exponent grows; the first grid point that is low enough bounds the answer above.
        fits = [t for t, entropy, epochs in measure(grid) if (entropy <= wanted if wanted is not None else epochs <= repeats)]
        high = min(fits, default=high)
        if high == low:
            break
        low = max([t for t in grid if t < high], default=low)
    return round(high, 6)


def plan(sources: DataFrame, evenness: float | None = EVENNESS, repeats: float | None = None, budget: int | None = None,
         keep_all: bool = False, block: int = BLOCK) -> DataFrame:
    """``source, tokens, docs, weight, budget, epochs, blocks`` of each source, as a small written table.

    ``budget``: tokens of the mixture; with ``keep_all`` the least with which every document comes once.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = None if keep_all else total if budget is None else budget
    exponent = bisect_exponent(sources, total, evenness, repeats, budget) if total else 1.0
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(exponent))).otherwise(0.0)
    rows = sources.withColumn("raised", raised)
    z, most = rows.agg(F.sum("raised"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("raised")))).first()
    weight = F.col("raised") / F.lit(z or 1.0)
    spend = F.lit(float(most or 0.0) * (z or 1.0) if budget is None else float(budget))
    wanted = F.floor(F.round(weight * spend, 3)).cast("long")
    wanted = F.greatest(wanted, "tokens") if budget is None else wanted
    epochs = F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")
    return materialize(rows.select("source", "tokens", "docs", weight.alias("weight"), wanted.alias("budget")).withColumn("epochs", epochs)
                       .withColumn("blocks", F.ceil(F.col("docs") / block).cast("long")), "mixing-plan")


def _key(*columns):
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def permutation(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``doc_id, mark, source, n_tokens, weight, epoch, position``: a row for each time a row is taken.

    ``rows`` has ``doc_id, mark, source, n_tokens``; ``position`` counts the tokens of the source's stream before it.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    number = F.conv(F.substring(_key(doc), 1, 8), 16, 10).cast("long")
    side = sources.select(F.col("source").alias("s"), "tokens", "weight", "budget", "epochs", "blocks")
    rows = rows.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("block", F.pmod(number, "blocks")).withColumn("group", F.floor(F.col("block") / block))
    rows = materialize(rows, "mixing-rows")
    name = F.coalesce(F.col("source"), F.lit(""))
    epoch = F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch")

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    blocks = rows.groupBy("source", "group", "block", "epochs").agg(F.sum("n_tokens").alias("n"))
    groups = blocks.groupBy("source", "group", "epochs").agg(F.sum("n").alias("n")).select("source", "group", epoch, "n")
    groups = groups.select(F.col("source").alias("s"), F.col("group").alias("g"), F.col("epoch").alias("e"), running(
        "n", Window.partitionBy("source", "epoch").orderBy(_key("epoch", name, F.lit("group"), "group"), "group")).alias("g_at"))
    blocks = blocks.select("source", "group", "block", epoch, "n")
    blocks = blocks.withColumn("b_at", running("n", Window.partitionBy("source", "epoch", "group").orderBy(
        _key("epoch", name, F.lit("block"), "block"), "block")))
    blocks = blocks.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")) & (F.col("epoch") == F.col("e"))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), F.col("epoch").alias("e"), (F.col("g_at") + F.col("b_at")).alias("base"))
    rows = rows.select("*", epoch)
    inside = Window.partitionBy("source", "epoch", "block").orderBy(_key("epoch", doc), "doc_id", "mark")
    rows = rows.withColumn("in_block", running("n_tokens", inside))
    rows = rows.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")) & (F.col("epoch") == F.col("e")))
    position = F.col("epoch") * F.col("tokens") + F.col("base") + F.col("in_block")
    rows = rows.withColumn("position", position)
    free = (F.col("n_tokens") == 0) & (F.col("epoch") == 0)
    return rows.where((F.col("position") + F.col("n_tokens") <= F.col("budget")) & ((F.col("n_tokens") > 0) | (F.col("epoch") == 0)) | free).select(
        "doc_id", "mark", "source", "n_tokens", "weight", "epoch", "position")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, **options) -> DataFrame:
    """``doc_id, source, n_tokens, weight, epoch, position`` of the mixture; ``mark`` is the hash of the text."""
    rows = materialize(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(source_col).alias("source"),
                                 F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens")), "mixing-counts")
    return permutation(rows, plan(source_totals(rows), block=block, **options), block)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mixture takes it. Rows of equal id and text are taken alike."""
    taken = mix(df, id_col, text_col, **options).select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "epoch").distinct()
    taken = taken.groupBy("_d", "_m").agg(F.count("*").cast("int").alias("_n"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    rows = rows.join(taken, F.col("id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m")))
    rows = rows.select("row", F.explode(F.sequence(F.lit(1), "_n")))
    return rows.select(*[F.col(f"row.`{c}`") for c in df.columns])


#: The same in DuckDB SQL over the table ``documents`` for the query's parameters, with weights to six decimals.
ORACLE = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
sources AS (SELECT source, sum(n) AS t, count(*) AS docs FROM counted GROUP BY source),
total AS (SELECT sum(t) AS t FROM sources),
shares AS (SELECT list(CAST(s.t AS DOUBLE) / total.t) AS ps, CAST(count(*) AS DOUBLE) AS k FROM sources s, total WHERE s.t > 0),
goal AS (SELECT ps, list_sum(list_transform(ps, lambda p: -p * ln(p))) + 0.5 * (ln(k) - list_sum(list_transform(ps, lambda p: -p * ln(p)))) AS h FROM shares),
search(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, lo + (hi - lo) * greatest(k - 1, 0) / 32, lo + (hi - lo) * k / 32
  FROM (SELECT i, lo, hi, list_min(list_filter(range(0, 33), lambda j:
          ln(list_sum(list_transform(ps, lambda p: pow(p, lo + (hi - lo) * j / 32))))
          - (lo + (hi - lo) * j / 32) * list_sum(list_transform(ps, lambda p: pow(p, lo + (hi - lo) * j / 32) * ln(p)))
            / list_sum(list_transform(ps, lambda p: pow(p, lo + (hi - lo) * j / 32))) <= h)) AS k
        FROM search, goal WHERE i < 5)),
exponent AS (SELECT round(hi, 6) AS e FROM search WHERE i = 5),
raised AS (SELECT source, s.t, docs, CASE WHEN s.t > 0 THEN pow(CAST(s.t AS DOUBLE) / total.t, e) ELSE 0 END AS x FROM sources s, total, exponent),
weights AS (SELECT source, r.t, docs, x / (SELECT sum(x) FROM raised) AS w FROM raised r),
plan AS (
  SELECT source, weights.t, w, CAST(floor(round(w * total.t, 3)) AS BIGINT) AS budget, CAST(ceil(docs / 1000.0) AS BIGINT) AS blocks,
         CASE WHEN weights.t > 0 THEN CAST(ceil(floor(round(w * total.t, 3)) / weights.t) AS BIGINT) ELSE 1 END AS epochs
  FROM weights, total),
placed AS (
  SELECT c.doc_id, c.source, c.n, p.t, p.w, p.budget, unnest(range(0, p.epochs)) AS epoch,
         ('0x' || substr(md5('mix|' || c.doc_id), 1, 8))::BIGINT % p.blocks AS block
  FROM counted c JOIN plan p ON c.source = p.source),
ordered AS (
  SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY
              md5('mix|' || epoch || '|' || source || '|group|' || (block // 1000)), block // 1000,
              md5('mix|' || epoch || '|' || source || '|block|' || block), block, md5('mix|' || epoch || '|' || doc_id), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
  FROM placed)
SELECT doc_id, source, n AS n_tokens, round(w * 1000000) / 1000000 AS weight, CAST(epoch AS INTEGER) AS epoch, CAST(position AS BIGINT) AS position
FROM ordered WHERE (position + n <= budget AND n > 0) OR (n = 0 AND epoch = 0)
"""
