"""Mixing sources to target weights by iterative proportional fitting, all in built-in functions.

Documents fall into cells (source, language, topic). Token weights of the cells are raked: scaled to
the target share of each source, then of each language, then of each topic, and again, until all
three hold (Deming and Stephan, 1940). A document is then drawn with the probability that its cell's
weight calls for, by a number that is a hash of its id, so a repeated run draws the same documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import HOT_KEYS, cut

DIMENSIONS = ("source", "lang", "topic")
#: Without stated targets, shares are raised to this power and scaled to one, which lifts small groups.
TEMPERATURE = 0.7
#: Share of all tokens that the drawn documents are expected to have.
BUDGET = 0.8
#: Raking ends when no marginal is off by more than this factor, or when a sweep no longer comes closer.
TOLERANCE = 1e-6
MOST_SWEEPS = 200
#: Tables of marginals and cells with up to this many rows are broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 100_000
UNKNOWN = "(none)"
WORD = r"[^ \t-\r]+"

#: Topics by the first rule that fits the text; rules are plain properties that SQL can state.
TOPIC_RULES = (
    ("legal", r"[Ll]icense|[Cc]opyright|©"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]"),
    ("listing", r" \| .* \| "),
    ("numeric", r"[0-9][0-9 ,.-]{6}"),
)


def topic_of(text: str | Column) -> Column:
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    out = F.when(column.rlike(TOPIC_RULES[0][1]), TOPIC_RULES[0][0])
    for name, pattern in TOPIC_RULES[1:]:
        out = out.when(column.rlike(pattern), name)
    return out.otherwise("prose")


def tempered(cells: DataFrame, dimension: str, power: float = TEMPERATURE) -> DataFrame:
    """Target share of every value of a dimension: its share of the tokens to a power, scaled to one."""
    sums = cut(cells.groupBy(dimension).agg(F.sum("tokens").alias("n")).where("n > 0").select(dimension, F.pow(F.col("n").cast("double"), power).alias("x")))
    total = sums.agg(F.sum("x")).first()[0] or 1.0
    return sums.select(dimension, (F.col("x") / total).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame]) -> tuple[DataFrame, float]:
    """``cells`` with ``weight``, their raked share of the tokens, and the largest factor still missing.

    A cell without tokens, or whose value has no target, weighs nothing. Where no weights can meet all targets (a
    topic that only one source has, say) sweeps settle in a cycle; the last sweep's weights are returned and
    the factor, then above 1 + ``TOLERANCE``, says how far the marginals are off.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    # every value once, with its target; factors have a row per value, so their number is known from here on
    shares = {d: cut(cells.select(d).distinct().join(t, d, "left").na.fill(0.0, ["share"])) for d, t in targets.items()}
    small = {d: s.count() <= BROADCAST_ROWS for d, s in shares.items()}
    names = list(cells.columns)
    off, before = 1.0, float("inf")
    for _ in range(MOST_SWEEPS):
        for i, (dimension, target) in enumerate(shares.items()):
            sums = state.groupBy(dimension).agg(F.sum("weight").alias("_sum"))
            factor = F.when(F.col("_sum") > 0, F.col("share") / F.col("_sum")).otherwise(0.0)
            factors = sums.join(F.broadcast(target) if small[dimension] else target, dimension).select(dimension, factor.alias(f"_f{i}"))
            state = state.join(F.broadcast(factors) if small[dimension] else factors, dimension)
            state = state.withColumn("weight", F.col("weight") * F.col(f"_f{i}"))
        state = cut(state)  # one job a sweep: three sums, three joins, one small table
        found = [F.col(f"_f{i}") for i in range(len(shares))]
        worst = state.agg(*(F.max(F.when(f > 0, F.greatest(f, 1 / f))) for f in found)).first()
        state = state.select(*names, "weight")
        off = max((x for x in worst if x), default=1.0)
        if off <= 1 + TOLERANCE or off > 1 + (before - 1) * 0.999:
            break
        before = off
    return state, off


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` with ``probability``: in proportion to weight per token, at most 1, worth ``budget`` of all tokens.

    What certain cells cannot take goes to the others, so the scale is found by raising it until the
    expected tokens fit; a cell that has become certain stays so, which bounds the rounds.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    rated = cut(cells.withColumn("_rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)))
    scale, sure = 0.0, -1
    while True:
        is_sure = F.col("_rate") * scale >= 1
        row = rated.agg(
            F.sum(F.when(is_sure, F.col("tokens"))).alias("full"), F.sum(F.when(~is_sure, F.col("weight"))).alias("open"),
            F.sum(is_sure.cast("long")).alias("n"),
        ).first()
        if (row["n"] or 0) == sure or not row["open"]:
            break
        sure = row["n"]
        scale = max(scale, (budget * total - float(row["full"] or 0)) / row["open"])
    return rated.withColumn("probability", F.least(F.lit(1.0), F.col("_rate") * scale)).drop("_rate")


def uniform(seed: int, doc_id: str | Column = "doc_id") -> Column:
    """A number in [0, 1) that follows from the id alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 11) / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    seed: int = 0,
    topic: Column | None = None,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """The ``carry`` columns of ``docs`` (all, if not given) with ``topic``, ``n_words``, ``weight``, ``probability``, ``sampled`` and ``miss``.

    Tokens are words. ``targets`` gives tables (value, share) by dimension; a dimension without one gets ``tempered``
    shares. ``weight`` is the raked share of the document's cell, and ``miss`` the factor by which the worst
    marginal is still off. ``sampled`` is decided by a hash of the id: rows of equal id in one cell share their
    fate. A null source or language is the value ``(none)``. Texts without words weigh nothing, so they
    count for no target, and are drawn with their cell's probability. An empty table gives no rows.
    Columns of the input that bear a name given out here, in letters of either case, are replaced; all other names may clash.

    What is asked of a text is worked out once; the carried columns are written down with it.
    """
    given = ("topic", "n_words", "weight", "probability", "sampled", "miss")
    row = F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns if c.lower() not in given])
    values = [F.coalesce(F.col(d), F.lit(UNKNOWN)).alias(d) for d in DIMENSIONS if d != "topic"]
    n_words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    chosen = (topic_of("text") if topic is None else topic).alias("topic")
    keyed = cut(docs.select(row.alias("row"), F.col("doc_id").alias("id"), *values, chosen, n_words))
    cells = cut(keyed.groupBy(*DIMENSIONS).agg(F.sum("n_words").alias("tokens"), F.count("*").alias("n")))
    targets = {d: (targets or {}).get(d) if (targets or {}).get(d) is not None else tempered(cells, d) for d in DIMENSIONS}
    raked, off = rake(cells, targets)
    rated = cut(probabilities(raked, budget).select(*DIMENSIONS, "n", "weight", "probability"))
    keys = list(DIMENSIONS)
    if rated.count() <= BROADCAST_ROWS:
        placed = keyed.join(F.broadcast(rated.drop("n")), keys)
    else:
        # more cells than may be broadcast: the large ones are few, the small ones meet in a shuffled join
        total = rated.agg(F.sum("n")).first()[0]
        hot = F.broadcast(rated.where(F.col("n") * HOT_KEYS >= total).drop("n"))
        cold = rated.where(F.col("n") * HOT_KEYS < total).drop("n")
        placed = keyed.join(hot, keys).unionByName(keyed.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
    sampled = (uniform(seed, F.col("id")) < F.col("probability")).alias("sampled")
    return placed.select("row.*", "topic", "n_words", "weight", "probability", sampled, F.lit(off).alias("miss"))
