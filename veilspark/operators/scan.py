"""Running folds over sorted rows of any length: prefix sums, exclusive or, and the row before, by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.stored import stored


def scan(rows: DataFrame, group: list[str], order: list, add: tuple = (), xor: tuple = (), last: tuple = ()) -> DataFrame:
    """rows with the columns of ``add`` and ``xor`` (longs) folded over the rows of their group up to this one, and those of
    ``last`` (longs, none null) as they were in the row before, null in the first. Rows of a group go by ``order``.

    Rows are cut into ranges of group and order, and each range folds its own, so a group may be of any length. The last row of
    each range goes to the driver, as many rows as ranges; what a range takes over from those before it comes back by a
    broadcast join. Columns of group hold no nulls. The folded rows are stored in the shared folder."""
    spark = rows.sparkSession
    names, folds = rows.columns, [*add, *xor, *last]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("__p", T.IntegerType()), T.StructField("__end", T.BooleanType()), *(T.StructField(f"__{c}", T.LongType()) for c in last)])

    def folded(batches):
        held, before, so_far = None, None, {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield held
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in {*group, *folds}}
            new = np.zeros(n, bool)
            for c in group:
                new[1:] |= column[c][1:] != column[c][:-1]
            carried = before == tuple(column[c][0] for c in group)
            new[0] = not carried
            start = np.flatnonzero(new | (np.arange(n) == 0))
            first = np.repeat(start, np.diff(np.append(start, n)))
            out = {}
            for c in add:
                total = np.cumsum(column[c])
                out[c] = total - (total - column[c])[first]
                out[c] += np.where(first == 0, so_far[c], 0) if carried else 0
            for c in xor:
                total = np.bitwise_xor.accumulate(column[c])
                out[c] = total ^ (total ^ column[c])[first]
                out[c] ^= np.where(first == 0, so_far[c], 0) if carried else 0
            shifted = []
            for c in last:
                out[c] = column[c]
                shifted.append(pa.array(np.concatenate([[so_far[c] if carried else 0], column[c][:-1]]), pa.int64(), mask=new))
            before, so_far = tuple(column[c][-1] for c in group), {c: out[c][-1] for c in folds}
            arrays = [pa.array(out[c], pa.int64()) if c in out else batch.column(c) for c in names]
            held = pa.RecordBatch.from_arrays([*arrays, batch.column("__p"), pa.array(np.zeros(n, bool)), *shifted], names=[*names, "__p", "__end", *(f"__{c}" for c in last)])
        if held is not None:
            end = np.zeros(held.num_rows, bool)
            end[-1] = True
            yield held.set_column(len(names) + 1, "__end", pa.array(end))

    local = stored(dealt.withColumn("__p", F.spark_partition_id()).mapInArrow(folded, schema))
    carry, state = [], None
    for r in sorted(local.where("__end").select("__p", *group, *folds).collect(), key=lambda r: r[0]):
        of_group, values = tuple(r[1 : 1 + len(group)]), tuple(r[1 + len(group) :])
        if state is not None:
            carry.append((r[0], *state[0], *state[1]))
            if state[0] == of_group:
                a, x = len(add), len(add) + len(xor)
                values = (*(m + n for m, n in zip(state[1][:a], values[:a], strict=True)), *(m ^ n for m, n in zip(state[1][a:x], values[a:x], strict=True)), *values[x:])
        state = (of_group, values)
    kinds = T.StructType([T.StructField("__p", T.IntegerType()), *(T.StructField(c, rows.schema[c].dataType) for c in group), *(T.StructField(f"__c_{c}", T.LongType()) for c in folds)])
    joined = local.join(F.broadcast(spark.createDataFrame(carry, kinds)), ["__p", *group], "left")
    done = {**{c: F.col(c) + F.coalesce(f"__c_{c}", F.lit(0)) for c in add}, **{c: F.col(c).bitwiseXOR(F.coalesce(f"__c_{c}", F.lit(0))) for c in xor}, **{c: F.coalesce(f"__{c}", f"__c_{c}") for c in last}}
    return joined.select(*(done[c].alias(c) if c in done else c for c in names))
