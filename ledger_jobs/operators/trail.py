"""Money in or out from the running balance.

Consecutive transactions up to each printed balance form a group whose signed amounts must add up
to the change of the balance.  Groups are numbered by windows over one partitioning by statement
block, in file order and in reverse.  A group of one transaction is solved by an expression where it
is; only the rows of larger ones (16 at most) leave, to try signs in numpy: all groups of one size
of a batch in one pass, or, from nine rows on, each by two halves of its signs.  Groups without a change of balance are never gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST = 16
_SOLVED = T.ArrayType(T.BooleanType())


def cents(x: Column) -> Column:
    return F.round(x * 100).cast("long")


#: Numbers that one batch of sign trials may hold, and the size from which groups are tried by halves.
_TRIALS, HALVED = 1 << 22, 9


def _masks(k: int) -> np.ndarray:
    return (np.arange(1 << k)[:, None] >> np.arange(k)) & 1


def _whole(amounts: np.ndarray, credit: np.ndarray, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_signs`` by all signs of all groups at once."""
    n, k = amounts.shape
    masks = _masks(k)
    signs, found = np.zeros((n, k), bool), np.zeros(n, bool)
    for at in range(0, n, max(1, _TRIALS >> k)):
        part = slice(at, at + max(1, _TRIALS >> k))
        guess = credit[part].astype(np.int64)
        right = (2 * masks - 1) @ amounts[part].T == deltas[part]
        changes = masks.sum(1)[:, None] + guess.sum(1) - 2 * (masks @ guess.T)
        best = np.where(right, changes, k + 1).argmin(0)
        signs[part], found[part] = masks[best] == 1, right.any(0)
    return signs, found


def _by_halves(amounts: np.ndarray, credit: np.ndarray, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_signs`` by meeting in the middle: the sums of the later half are sorted, each with its
    fewest changes and smallest number first, and each sum of the earlier half looks up what it lacks."""
    n, k = amounts.shape
    half = k // 2
    low, high = _masks(half), _masks(k - half)
    signs, found = np.zeros((n, k), bool), np.zeros(n, bool)
    early, late = amounts[:, :half] @ (2 * low - 1).T, amounts[:, half:] @ (2 * high - 1).T
    for g in range(n):
        changed_low, changed_high = (low != credit[g, :half]).sum(1), (high != credit[g, half:]).sum(1)
        order = np.lexsort((changed_high, late[g]))  # stable: of equal ones the smallest number is first
        sums = late[g][order]
        at = np.searchsorted(sums, deltas[g] - early[g])
        i = np.flatnonzero((at < len(sums)) & (sums[np.minimum(at, len(sums) - 1)] == deltas[g] - early[g]))
        if len(i):
            j = order[at[i]]
            best = np.lexsort((i, j, changed_low[i] + changed_high[j]))[0]
            signs[g], found[g] = np.concatenate((low[i[best]], high[j[best]])) == 1, True
    return signs, found


def best_signs(amounts: np.ndarray, credit: np.ndarray, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of one size (rows of ``amounts`` and of the guess ``credit``) the signs (credit or
    not) whose sum is the group's delta, with the fewest changes of the guess; of several, the
    smallest as a binary number whose lowest digit is the first amount.  Also whether there are any."""
    return (_whole if amounts.shape[1] < HALVED else _by_halves)(amounts, credit, deltas)


@F.pandas_udf(_SOLVED)
def _solve(amounts: pd.Series, credits: pd.Series, deltas: pd.Series) -> pd.Series:
    sizes, out = amounts.map(len).to_numpy(), np.empty(len(amounts), object)
    for k in np.unique(sizes):
        at = np.flatnonzero(sizes == k)
        signs, found = best_signs(
            np.stack(amounts.iloc[at].to_list()).astype(np.int64), np.stack(credits.iloc[at].to_list()).astype(bool), deltas.iloc[at].to_numpy(np.int64)
        )
        for i, s, ok in zip(at, signs, found, strict=True):
            out[i] = s.tolist() if ok else None
    return pd.Series(out)


def _grouped(rows: DataFrame, keys: list[str], reverse: bool) -> DataFrame:
    """``rows`` with the group that each is in when walked in one direction: its number (``closed``,
    ``restarts``), its size ``k``, the change ``delta`` of the balance that it must add up to (null
    without two balances), and for groups of one row whether that is a ``credit``.

    A group is what lies between two balances; a balance known before a row starts another one,
    and what was open is left without an end.
    """
    walk = Window.partitionBy(*keys).orderBy(F.desc("txn_seq") if reverse else F.asc("txn_seq"))
    before = walk.rowsBetween(Window.unboundedPreceding, -1)
    known = F.lit(None).cast("long") if reverse else F.col("known_level")
    rows = rows.withColumns(
        {
            "closed": F.count("level").over(before),
            "restarts": F.count(known).over(walk.rowsBetween(Window.unboundedPreceding, 0)),
            "previous": F.last("level", ignorenulls=True).over(before),
            "known": known,
        }
    )
    group = Window.partitionBy(*keys, "closed", "restarts")
    rows = rows.withColumns(
        {"k": F.count("*").over(group), "delta": F.max("level").over(group) - F.coalesce(F.max("known").over(group), F.max("previous").over(group))}
    )
    fits = lambda change: (F.col("k") == 1) & (F.col("delta") == change)
    # an amount of zero fits either way: the guess stays
    one = F.when(fits(F.col("cents")) & fits(-F.col("cents")), F.col("guess")).when(fits(F.col("cents")), True).when(fits(-F.col("cents")), False)
    way = F.struct("closed", "restarts", "k", "delta", one.alias("credit"))
    return rows.withColumn("back" if reverse else "forth", way).drop("closed", "restarts", "previous", "known", "k", "delta")


def _hard(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, txn_seq, forth_credit, back_credit) of the rows in groups of two to ``MOST``."""
    ways = F.array(*[F.struct(F.lit(w).alias("way"), F.col(w).alias("g")) for w in ("forth", "back")])
    rows = rows.select(*keys, "txn_seq", "cents", "guess", F.explode(ways).alias("w")).select(*keys, "txn_seq", "cents", "guess", "w.way", "w.g.*")
    rows = rows.filter(F.col("k").between(2, MOST) & F.col("delta").isNotNull())
    place = F.when(F.col("way") == "back", -F.col("txn_seq")).otherwise(F.col("txn_seq"))
    items = F.array_sort(F.collect_list(F.struct(place.alias("at"), "txn_seq", "cents", "guess"))).alias("items")
    solved = rows.groupBy(*keys, "way", "closed", "restarts", "delta").agg(items).withColumn("signs", _solve("items.cents", "items.guess", "delta"))
    flat = solved.filter("signs IS NOT NULL").select(*keys, "way", F.explode(F.arrays_zip("items.txn_seq", "signs").cast("array<struct<txn_seq: bigint, sign: boolean>>")).alias("x"))
    sign = [F.max(F.when(F.col("way") == w, F.col("x.sign"))).alias(f"{w}_credit") for w in ("forth", "back")]
    return flat.groupBy(*keys, F.col("x.txn_seq").alias("txn_seq")).agg(*sign)


def fix_directions(txns: DataFrame, keys: tuple[str, ...] = ("doc_id", "block_no")) -> DataFrame:
    """``txns`` (with ``known_before``, a balance known just before a row, or without) with the
    directions that their balances prove.

    File order and reverse order are tried; the reverse wins only if it solves strictly more, and
    nothing changes unless at least two transactions and three fifths of the checked are solved.
    """
    by = list(keys)
    known = F.col("known_before") if "known_before" in txns.columns else F.lit(None).cast("double")
    # only what the trail needs goes through its windows; directions that change come back by a join
    rows = txns.select(
        *by, "txn_seq", cents(F.col("balance")).alias("level"), cents(known).alias("known_level"), cents(F.col("amount")).alias("cents"), (F.col("direction") == "credit").alias("guess")
    )
    rows = _grouped(_grouped(rows, by, False), by, True)
    rows = rows.join(_hard(rows, by), [*by, "txn_seq"], "left")
    block = Window.partitionBy(*by)
    rows = rows.withColumns({w: F.struct(f"{w}.delta", F.coalesce(f"{w}.credit", f"{w}_credit").alias("credit")) for w in ("forth", "back")})
    counts = {f"{w}_{n}": F.count(f"{w}.{c}").over(block) for w in ("forth", "back") for n, c in (("solved", "credit"), ("checked", "delta"))}
    rows = rows.withColumns(counts)
    use = F.col("back_solved") > F.col("forth_solved")
    solved, checked, credit = (F.when(use, F.col(f"back{x}")).otherwise(F.col(f"forth{x}")) for x in ("_solved", "_checked", ".credit"))
    proven = rows.filter((solved >= 2) & (solved * 10 >= checked * 6) & (credit != F.col("guess")))
    changed = proven.select(*by, "txn_seq", F.when(credit, "credit").otherwise("debit").alias("proven"))
    out = txns.join(changed, [*by, "txn_seq"], "left")
    return out.withColumn("direction", F.coalesce("proven", "direction")).select(*txns.columns)
