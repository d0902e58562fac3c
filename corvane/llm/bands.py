"""Numeric band join: every item with all lines whose unit price lies near its own.

No pair is formed to be counted. Lines are summed by unit price, and prefix sums of their count,
unit price and crc run over the sorted prices: dealt by range, summed in each partition, and
carried on by one row for each partition. An item reads them at the ends of its interval; the
differences are the totals over the lines of all items. What its own lines add is read in the same
way from prefix sums in the order of (item, unit price), and taken off. A hot price or a hot item
is a few sums more in the first case and falls over many partitions in the second.

The nearest lines come from cursors that start at an item's price and step outward through the
sorted lines, once downward and once upward, past the item's own lines, until they have enough or
leave the interval. Lines that no item can list are taken out first, without loss: of lines with one
price and one item those behind the first `most`, and then of those with one price the ones behind
the first 2 * `most`, of which at least `most` belong to other items. A partition hands on the last
2 * `most` lines that it has, at most `most` of an item, so that cursors that run into its start
are carried on by one bounded row for each partition before it. There are at most MOST_RANGES
partitions whatever the input, and a task holds one batch and 2 * `most` lines.

Defined results. Unit price: floor((2 a + q) / (2 q)) of cents a and quantity q, in whole numbers.
Lines null in sale, item, quantity or amount, with quantity zero or an amount that is no finite
number of cents never pair; neither do items without such a price, which have one row of rank 0. A
null line number stands first among its ties and is left out of the crc's text. Repeated lines
each count and take a rank each; repeated items each have their rows. An item without id has no
lines of its own. An empty table of lines gives rows of rank 0, one of items an empty result.
Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize

MOST = 10
APART = 50
PER_MILLE = 5
MOST_RANGES = 4096
_NONE = -(1 << 62)  # stands for null where rows are dealt by range and held in arrays
_LINE = "struct<u: long, sale_id: long, line_no: long, line_item_id: long>"
_FIELDS = ("u", "sale_id", "line_no", "line_item_id")


def cents(amount: Column) -> Column:
    """Whole cents of an amount, null unless they are a number of 62 bits."""
    x = F.floor(F.lit(100.0) * amount.cast("double") + 0.5)
    return F.when(F.abs(100.0 * amount.cast("double")) < float(1 << 61), x).cast("long")


def unit_price(a: Column, quantity: Column) -> Column:
    """floor((2 a + q) / (2 q)) in whole numbers, null for a quantity of zero."""
    sign = F.when(quantity < 0, F.lit(-1)).otherwise(1)
    above, below = (2 * a + quantity) * sign, 2 * quantity * sign
    return F.call_function("div", above - F.pmod(above, below), F.when(quantity != 0, below))


def interval(p: Column, apart: int = APART, per_mille: int = PER_MILLE) -> tuple[Column, Column]:
    """The least and the greatest u with |u - p| <= apart or 1000 |u - p| <= per_mille * min(u, p)."""
    div = lambda x, by: F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))  # noqa: E731  toward minus infinity
    least = -div(-1000 * p, 1000 + per_mille)
    most = div((1000 + per_mille) * p, 1000)
    return F.least(p - apart, least), F.greatest(p + apart, most)


def _lines(lines: DataFrame) -> DataFrame:
    """u, sale_id, line_no, line_item_id, crc of the lines that can pair."""
    ids = [F.col(c).cast("long") for c in ("sale_id", "line_no", "item_id")]
    u = unit_price(cents(F.col("amount")), F.col("quantity").cast("long"))
    crc = F.crc32(F.concat_ws(",", *[c.cast("string") for c in ids]).cast("binary"))
    read = lines.select(u.alias("u"), ids[0].alias("sale_id"), ids[1].alias("line_no"), ids[2].alias("line_item_id"), crc.alias("crc"))
    return read.where("u is not null and sale_id is not null and line_item_id is not null")


def _items(items: DataFrame, apart: int, per_mille: int) -> DataFrame:
    """id (of the row), item_id, p, least, most; fixed rows, so that the id is the same wherever it is read."""
    p = cents(F.col("price"))
    least, most = interval(p, apart, per_mille)
    read = items.select(F.col("item_id").cast("long").alias("item_id"), p.alias("p"), least.alias("least"), most.alias("most"))
    return materialize(read.withColumn("id", F.monotonically_increasing_id()), "band-items")


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in their order over at most MOST_RANGES partitions."""
    n = min(MOST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


# --- totals: prefix sums -----------------------------------------------------------------------


def _running(batches: Iterator[pa.RecordBatch], sums: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with an end, with the partition's sums up to there; then one row with its totals."""
    part, before = TaskContext.get().partitionId(), np.zeros(len(sums), np.int64)
    number = lambda values: pa.array(values, pa.int64())
    for b in batches:
        end = np.flatnonzero(b.column("id").is_valid().to_numpy(zero_copy_only=False))
        so_far = []
        for k, name in enumerate(sums):
            x = np.cumsum(b.column(name).fill_null(0).to_numpy()) + before[k]
            before[k] = x[-1]
            so_far.append(x[end])
        kept = [b.column(c).take(pa.array(end)) for c in ("id", "p", "counts", "apart")]
        yield pa.RecordBatch.from_arrays([*kept, *map(number, so_far), number([part] * len(end))], ["id", "p", "counts", "apart", *sums, "part"])
    yield pa.RecordBatch.from_arrays([number([None])] * 4 + [number([x]) for x in before] + [number([part])], ["id", "p", "counts", "apart", *sums, "part"])


def at_ends(rows: DataFrame, ends: DataFrame, group: str, sums: list[str]) -> DataFrame:
    """ends with the sums over all rows up to (group, x) of each end, in that order. rows: group, x, sums; ends: group, x, id, p, counts, apart."""
    empty = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    own = F.coalesce(group, F.lit(_NONE)).alias(group)
    both = rows.select(own, "x", *empty("id", "p", "counts", "apart"), *sums).unionByName(ends.select(own, "x", "id", "p", "counts", "apart", *empty(*sums)))
    order = [group, "x", "id"]  # nulls come first: an end counts the rows at its own place
    numbers = ", ".join(f"{c} long" for c in ("id", "p", "counts", "apart", *sums, "part"))
    read = materialize(_dealt(both, order).mapInArrow(lambda it: _running(it, sums), numbers), "running-sums")
    # one row for each partition; decimals, as sums over everything may pass 64 bits
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums]
    starts = read.where("id is null").select("part", *before)
    placed = read.where("id is not null").join(F.broadcast(starts), "part")
    return placed.select("id", "p", "counts", "apart", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in sums])


def _totals(lines: DataFrame, items: DataFrame) -> DataFrame:
    """id, n, gap, crc: signed parts, whose sums by id are the totals over the item's pairs."""
    by_item = lines.groupBy("line_item_id", "u").agg(F.count("*").alias("n"), F.sum("crc").alias("crc"))
    by_item = materialize(by_item, "by-item-and-price")
    sums = ["n", "s", "crc"]
    whole = lambda df: df.withColumn("s", F.col("x") * F.col("n"))
    prices = whole(by_item.groupBy(F.col("u").alias("x")).agg(F.sum("n").alias("n"), F.sum("crc").alias("crc"))).withColumn("line_item_id", F.lit(None).cast("long"))
    own = whole(by_item.select("line_item_id", F.col("u").alias("x"), "n", "crc"))
    # of each end: how its count and its sum of (u - p) go into the totals
    end = lambda x, counts, apart: F.struct(x.alias("x"), F.lit(counts).cast("long").alias("counts"), F.lit(apart).cast("long").alias("apart"))
    three = F.array(end(F.col("most"), 1, 1), end(F.col("p") - 1, 0, -2), end(F.col("least") - 1, -1, 1))
    ends = items.where("p is not null").select("id", "p", F.col("item_id").alias("line_item_id"), F.explode(three).alias("e")).select("id", "p", "line_item_id", "e.*")
    every = at_ends(prices, ends.withColumn("line_item_id", F.lit(None).cast("long")), "line_item_id", sums).withColumn("sign", F.lit(1))
    same = at_ends(own, ends, "line_item_id", sums).withColumn("sign", F.lit(-1))
    gap = (F.col("s") - F.col("p").cast("decimal(20,0)") * F.col("n")) * F.col("apart") * F.col("sign")
    count = lambda c: F.col(c) * F.col("counts") * F.col("sign")
    big = lambda c, name: c.cast("decimal(38,0)").alias(name)
    return every.unionByName(same).select("id", big(count("n"), "n"), big(gap, "gap"), big(count("crc"), "crc"))


# --- the nearest lines: cursors ----------------------------------------------------------------


def _last(held: np.ndarray, most: int) -> np.ndarray:
    """The last 2 * most of the lines (rows of held), at most most of an item, in their order."""
    item = held[::-1, 3]
    by = np.argsort(item, kind="stable")
    first = np.flatnonzero(np.diff(item[by], prepend=item[by][:1] - 1))
    rank = np.empty(len(item), np.int64)
    rank[by] = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
    return held[::-1][np.flatnonzero(rank < most)[: 2 * most]][::-1]


def _listed(held: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Lists of lines, the i-th up to ends[i]."""
    fields = [pa.array(held[:, k], pa.int64()) for k in range(4)]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.StructArray.from_arrays(fields, list(_FIELDS)))


def step_outward(held: np.ndarray, start: np.ndarray, own: np.ndarray, bound: np.ndarray, most: int, down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cursors over lines in the order in which they are met last: (found indexes, how many, whether the start was run into).

    start: for each cursor the number of lines before it. own: the item to pass over. bound: the
    last u that counts.
    """
    at, n = start - 1, np.zeros(len(start), np.int64)
    found, open_ = np.zeros((len(start), most), np.int64), np.zeros(len(start), bool)
    going = np.arange(len(start))
    while len(going):
        ran_out = at[going] < 0
        open_[going[ran_out]] = True
        going = going[~ran_out]
        u = held[at[going], 0]
        going = going[u >= bound[going] if down else u <= bound[going]]
        other = going[held[at[going], 3] != own[going]]
        found[other, n[other]] = at[other]
        n[other] += 1
        at[going] -= 1
        going = going[n[going] < most]
    return found, n, open_


def _scan(batches: Iterator[pa.RecordBatch], most: int, down: bool) -> Iterator[pa.RecordBatch]:
    """For each item its nearest lines on one side, as far as the partition has them; then a row with the partition's last lines."""
    part, carried = TaskContext.get().partitionId(), np.empty((0, 4), np.int64)
    names = ["id", "item_id", "bound", "part", "open", "lines"]
    for b in batches:
        line = ~b.column("id").is_valid().to_numpy(zero_copy_only=False)
        column = lambda c, b=b: b.column(c).fill_null(_NONE).to_numpy()
        held = np.concatenate([carried, np.stack([column(c)[line] for c in _FIELDS], 1)])
        before = len(carried) + np.cumsum(line)[~line]
        own, bound = column("item_id")[~line], column("bound")[~line]
        found, n, open_ = step_outward(held, before, own, bound, most, down)
        flat = held[found[np.arange(most)[None, :] < n[:, None]]]
        ids = b.column("id").filter(pa.array(~line))
        arrays = [ids, pa.array(own), pa.array(bound), pa.array(np.full(len(own), part)), pa.array(open_), _listed(flat, np.cumsum(n))]
        yield pa.RecordBatch.from_arrays(arrays, names)
        carried = _last(held, most)
    last = [pa.array([None], pa.int64())] * 3 + [pa.array([part], pa.int64()), pa.array([False]), _listed(carried[::-1], np.array([len(carried)]))]
    yield pa.RecordBatch.from_arrays(last, names)


def _carried_on(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """From the last lines of each partition, the last ones of all partitions before each."""
    carried = np.empty((0, 4), np.int64)
    for b in batches:
        parts, before = [], []
        for part, lines in zip(b.column("part").to_pylist(), b.column("lines"), strict=True):
            parts.append(part)
            before.append(carried[::-1])
            own = np.array([[x[c] for c in _FIELDS] for x in lines.as_py()], np.int64).reshape(-1, 4)[::-1]
            carried = _last(np.concatenate([carried, own]), most)
        lists = _listed(np.concatenate([np.empty((0, 4), np.int64), *before]), np.cumsum([len(x) for x in before]))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), lists], ["part", "before"])


def nearest(lines: DataFrame, items: DataFrame, most: int, down: bool) -> DataFrame:
    """id, lines: each item's nearest lines with u < p (down) or u >= p, the nearest first, at most `most`."""
    turn = 1 if down else -1  # the other way the order is turned round
    empty = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    # ties from last to first, so that the first is met first
    met = [(-F.col(c)).alias(f"_{k}") for k, c in enumerate(_FIELDS[1:])]
    line = lines.select((turn * F.col("u")).alias("x"), F.lit(1).alias("turn"), *met, *empty("id", "item_id", "bound"), *_FIELDS)
    bound = F.col("least") if down else F.col("most")
    item = items.where("p is not null").select(
        (turn * F.col("p")).alias("x"), F.lit(0 if down else 2).alias("turn"), F.col("id").alias("_0"), *empty("_1", "_2"), "id", "item_id", bound.alias("bound"), *empty(*_FIELDS)
    )
    schema = f"id long, item_id long, bound long, part long, open boolean, lines array<{_LINE}>"
    dealt = _dealt(line.unionByName(item), ["x", "turn", "_0", "_1", "_2"])
    read = materialize(dealt.mapInArrow(lambda it: _scan(it, most, down), schema), "cursors")
    # one row of at most 2 * most lines for each partition
    last = read.where("id is null").select("part", "lines").coalesce(1).sortWithinPartitions("part")
    before = last.mapInArrow(lambda it: _carried_on(it, most), f"part long, before array<{_LINE}>")
    on = read.where("id is not null and open").join(F.broadcast(before), "part")
    within = (lambda x: x["u"] >= F.col("bound")) if down else (lambda x: x["u"] <= F.col("bound"))
    more = F.filter("before", lambda x: (x["line_item_id"] != F.col("item_id")) & within(x))
    on = on.select("id", F.slice(F.concat("lines", more), 1, most).alias("lines"))
    return read.where("id is not null and not open").select("id", "lines").unionByName(on)


def _can_be_listed(lines: DataFrame, most: int) -> DataFrame:
    """The first `most` lines of each price and item, and of those the first 2 * most of each price."""
    held = lines.select("u", "sale_id", F.coalesce("line_no", F.lit(_NONE)).alias("line_no"), "line_item_id")
    for keys, n in ((["u", "line_item_id"], most), (["u"], 2 * most)):
        order = Window.partitionBy(*keys).orderBy("sale_id", "line_no", "line_item_id")
        held = held.withColumn("_no", F.row_number().over(order)).where(F.col("_no") <= n).drop("_no")  # tasks take out theirs before the shuffle
    return materialize(held, "band-lines")


def near_prices(lines: DataFrame, items: DataFrame, most: int = MOST, apart: int = APART, per_mille: int = PER_MILLE) -> DataFrame:
    """item_id, rank, gap, u, sale_id, line_no, line_item_id, n_pairs, gap_sum, lines_crc.

    An item pairs with every line of another item whose unit price u is at most `apart` cents, or
    per_mille thousandths of the lesser of both, from its price. Of each row of items the first
    `most` pairs by (gap, u, sale_id, line_no, line_item_id) are listed, and totals over all of them.
    """
    read = _lines(lines)
    placed = _items(items, apart, per_mille)
    listed = _can_be_listed(read, most)
    zero = lambda name: F.lit(0).cast("decimal(38,0)").alias(name)
    no_lines = F.array().cast(f"array<{_LINE}>").alias("lines")
    none = [F.lit(None).cast("long").alias(c) for c in ("item_id", "p")]
    rows = placed.select("id", "item_id", "p", zero("n"), zero("gap"), zero("crc"), no_lines)
    rows = rows.unionByName(_totals(read, placed).select("id", *none, "n", "gap", "crc", no_lines))
    for down in (True, False):
        rows = rows.unionByName(nearest(listed, placed, most, down).select("id", *none, zero("n"), zero("gap"), zero("crc"), "lines"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    found = rows.groupBy("id").agg(
        F.max("item_id").alias("item_id"), F.max("p").alias("p"), total("n", "n_pairs"), total("gap", "gap_sum"), total("crc", "lines_crc"), F.flatten(F.collect_list("lines")).alias("lines")
    )
    known = lambda c: F.when(c != _NONE, c)
    ranked = F.transform("lines", lambda x: F.struct(F.abs(x["u"] - F.col("p")).alias("gap"), x["u"].alias("u"), x["sale_id"].alias("sale_id"), x["line_no"].alias("line_no"), x["line_item_id"].alias("line_item_id")))
    first = found.withColumn("lines", F.slice(F.array_sort(ranked), 1, most))
    out = first.select("item_id", F.posexplode_outer("lines").alias("_at", "x"), "n_pairs", "gap_sum", "lines_crc")
    rank = F.coalesce(F.col("_at") + 1, F.lit(0)).cast("int").alias("rank")
    return out.select("item_id", rank, "x.gap", "x.u", "x.sale_id", known(F.col("x.line_no")).alias("line_no"), "x.line_item_id", "n_pairs", "gap_sum", "lines_crc")
