"""Window reducers: named aggregates as partial aggregations, and ordered folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = ("count", "sum", "min", "max", "avg")


def named(spec: dict[str, Callable | None], value: Column) -> list[Column]:
    """Columns of an aggregate: reserved names have their meaning, any other name is a running sum.

    Extractors take the value; a result that isn't a number is null. count adds the number, or one where
    there is none; sums take null as zero; min, max and avg pass over it.
    """
    out = []
    for name, extract in spec.items():
        x = extract(value) if extract is not None else None
        if name == "count":
            out.append((F.count(F.lit(1)) if x is None else F.sum(F.coalesce(x, F.lit(1)))).alias(name))
            continue
        if x is None:
            raise ValueError(f"{name} needs an extractor")
        if name == "min":
            out.append(F.min(x).alias(name))
        elif name == "max":
            out.append(F.max(x).alias(name))
        elif name == "avg":
            total, n = F.coalesce(F.sum(x), F.lit(0)), F.count(x)
            out += [F.try_divide(total, n).alias("avg"), total.alias("__avg_sum"), n.alias("__avg_count")]
        else:
            out.append(F.sum(F.coalesce(x, F.lit(0))).alias(name))
    return out


def aggregate(rows: DataFrame, spec: dict, keys: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(*keys).agg(*named(spec, F.col(value)))


def fold(rows: DataFrame, initial: Column, step: Callable[[Column, Column], Column], keys: list[str], value: str = "value", order: tuple[str, ...] = ("ts", "id"), name: str = "value") -> DataFrame:
    """An ordered fold of each window's values in the JVM. A window's values are held together, as the fold's order asks."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    grouped = rows.groupBy(*keys).agg(listed.alias("_all"))
    return grouped.select(*keys, F.aggregate("_all", initial, lambda acc, x: step(acc, x["_v"])).alias(name))


def fold_python(rows: DataFrame, initial, step: Callable, keys: list[str], schema: str, value: str = "value", order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """An ordered fold by an opaque Python function; initial is copied for each window."""
    import copy

    def run(pdf):
        acc = copy.deepcopy(initial)
        for v in pdf.sort_values(list(order))[value]:
            acc = step(acc, v)
        out = pdf.iloc[:1][keys].copy()
        out["result"] = [acc]
        return out

    fields = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes)
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, result {schema}")
