"""Nested records: assembly, JSON, contract checks, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zones of a record in their order.
ORDER = ("drinking", "feeding", "resting", "open_movement", "outside")
VERSION = "room-record-1.0"
RECORD = "struct<version:string,session_id:bigint,date:string,zones:array<struct<zone:string,share:double,n:bigint>>,mean:double>"


def records(df: DataFrame, keys: list[str]) -> DataFrame:
    """One struct for each group of zone rows (zone, n, mean): all zones in order, null share for an absent zone."""
    per = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("zone", F.struct("n", "mean")))).alias("m"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("mean")).alias("s"))
    zone = lambda z: F.struct(F.lit(z).alias("zone"), (F.col("m")[z]["n"] / F.col("total")).alias("share"), F.col("m")[z]["n"].alias("n"))
    rec = F.struct(F.lit(VERSION).alias("version"), F.col(keys[0]).alias("session_id"), F.col(keys[1]).cast("string").alias("date"),
                   F.array(*[zone(z) for z in ORDER]).alias("zones"), (F.col("s") / F.col("total")).alias("mean"))
    return per.select(*keys, rec.alias("record"))


def to_text(record: Column) -> Column:
    """JSON that keeps null fields."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def errors(record: Column) -> Column:
    """Names of the broken rules of a record."""
    rules = {
        "missing_record": record.isNull(), "version": record["version"] != VERSION, "date": record["date"].try_cast("date").isNull(),
        "zone_order": ~F.transform(record["zones"], lambda z: z["zone"]).eqNullSafe(F.array(*map(F.lit, ORDER))),
        "share_range": F.exists(record["zones"], lambda z: z["share"].isNotNull() & ((z["share"] < 0) | (z["share"] > 1))),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def audit(df: DataFrame, key: list[str]) -> DataFrame:
    """Counts over records and their JSON read back: rows, distinct keys, faulty records, largest round-trip error."""
    back = df.withColumn("text", to_text(F.col("record"))).withColumn("again", F.from_json("text", RECORD)).withColumn("bad", F.size(errors(F.col("again"))) > 0)
    return back.agg(F.count("*").alias("records"), F.count_distinct(*key).alias("distinct_keys"), F.sum(F.col("bad").cast("int")).alias("faulty"),
                    F.max(F.abs(F.col("again.mean") - F.col("record.mean"))).alias("max_error"),
                    F.sum(F.size(F.filter("again.zones", lambda z: z["share"].isNull()))).alias("absent_zones"))


#: Fields of a record with their kinds, whether they must be there, and their ranges (fixed names of the contract).
FIELDS = (("version", "string", True, None), ("session_id", "long", True, (0, None)), ("date", "string", True, None), ("zones", "array", True, None), ("mean", "double", False, None))


def schema_errors(text: Column) -> Column:
    """Broken rules of a record's JSON text: no object, fields that are missing, unknown, of another kind or out of range."""
    v = F.try_parse_json(text)
    kind = {"string": "STRING", "long": "BIGINT", "double": "DOUBLE", "array": "ARRAY"}
    object_ = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    rules = [F.when(~object_, F.lit("not_an_object"))]
    keys = F.map_keys(F.from_json(text, "map<string,string>"))
    for name, k, needed, span in FIELDS:
        own = F.try_variant_get(v, f"$.{name}", "variant")
        is_kind = F.coalesce(F.schema_of_variant(own), F.lit("VOID"))
        absent = ~F.array_contains(keys, name)
        if needed:
            rules.append(F.when(object_ & (absent | (is_kind == "VOID")), F.lit(f"missing:{name}")))
        fits = is_kind.startswith(kind[k]) | (is_kind == "VOID") | (F.lit(k == "double") & is_kind.rlike("^(BIGINT|DECIMAL)"))
        rules.append(F.when(object_ & ~absent & ~fits, F.lit(f"kind:{name}")))
        if span:
            rules.append(F.when(object_ & (F.try_variant_get(v, f"$.{name}", "double") < span[0]), F.lit(f"range:{name}")))
    known = F.array(*[F.lit(n) for n, *_ in FIELDS])
    rules.append(F.when(object_ & (F.size(F.array_except(keys, known)) > 0), F.lit("unknown_field")))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())
