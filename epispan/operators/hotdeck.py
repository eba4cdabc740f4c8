"""Draw donor values for recipients, with replacement and reproducibly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispan.functions.hashing import stable_hash
from epispan.operators.ranking import hash_rank

UNMATCHED = 2**31


def donor_index(donors: DataFrame, id_col: str, by: Sequence[str], seed: int) -> DataFrame:
    """Number the donors of each group 0..n-1 in a reproducible random order."""
    order = stable_hash(seed, F.lit("donor"), id_col)
    return hash_rank(donors, order, id_col, by, out="donor_index").withColumnRenamed(
        "group_rows", "n_donors"
    )


def hot_deck_sample(
    donors: DataFrame,
    recipients: DataFrame,
    *,
    values: Sequence[str],
    id_col: str,
    by: Sequence[str],
    seed: int,
    salt: str,
    on_empty: str = "error",
    needed: Column | None = None,
) -> DataFrame:
    """Give every recipient the values of one donor drawn from its group.

    ``by`` names a handful of groups (experiments).  The drawn index is uniform, so the equi join
    on (group, donor index) spreads evenly; AQE broadcasts the donors when they are few.
    A group without donors raises, or loses its recipients with ``on_empty='drop'``.  Recipients
    for which ``needed`` is false stay, without values.
    """
    by = list(by)
    if on_empty == "error" and donors.isEmpty():
        # an empty side would let the optimizer skip the row-level check below
        raise ValueError("no donors to draw from")
    ranked = donor_index(donors.select(id_col, *by, *values), id_col, by, seed).drop(id_col)
    sizes = donors.groupBy(*by).agg(F.count(F.lit(1)).alias("n_donors"))
    keyed = recipients.join(F.broadcast(sizes), by, "left")
    served = F.col("n_donors").isNotNull()
    if needed is not None:
        served = served | ~needed
    if on_empty == "drop":
        keyed = keyed.where(served)
    else:
        refuse = F.raise_error(F.lit("no donors to draw from")).cast("boolean")
        keyed = keyed.where(F.when(served, F.lit(True)).otherwise(refuse))
    # rows that find no donor still get spread-out keys
    drawn = F.pmod(stable_hash(seed, F.lit(salt), id_col), F.coalesce("n_donors", F.lit(UNMATCHED)))
    keyed = keyed.withColumn("donor_index", drawn).drop("n_donors")
    kind = "inner" if needed is None else "left"
    return keyed.join(ranked.drop("n_donors"), [*by, "donor_index"], kind).drop("donor_index")
