"""Problem 2: timestamps of mixed formats and zones as one UTC instant each.

Every value becomes an array of its valid interpretations (day order, side of a clock change, unit of an
epoch number), each with its format. Per source, the records in their order form a chain; Viterbi chooses
one interpretation per record, penalising a change of format, a step back in time and an interpretation
that the source's declared day order speaks against.

All records are sorted by source, time and id in ranges, so that rows without a time or many rows of one
hour spread like any others, and the chain of a source is cut into blocks of at most BLOCK_ROWS consecutive
records. The readings are worked out once and written to the checkpoint folder. A block is summed up by
the cheapest cost from each interpretation of its first record to each of its last (a min-plus matrix);
the summaries, a row per block, are chained per source, which fixes the ends of every block; then the
blocks are decoded apart. The result is that of one pass over the whole chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.common import cut_lineage

BLOCK_ROWS = 5_000
SWITCH, BACKWARD, UNDECLARED = 1.0, 2.0, 16.0
_DAY_US = 86_400_000_000

#: Month names by language, fixed values. Forms of three letters and with a full stop are prefixes of these.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
}
#: Minutes east of UTC of zone abbreviations, fixed values; where one abbreviation names several zones, by the source's zone.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "BRT": -180, "ART": -180, "JST": 540, "KST": 540, "IST": 330,
    "NPT": 345, "PKT": 300, "SGT": 480, "HKT": 480, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
ABBREVIATIONS_BY_ZONE = {("IST", "Europe/Dublin"): 60, ("IST", "Asia/Jerusalem"): 120, ("CST", "Asia/Shanghai"): 480, ("BST", "Asia/Dhaka"): 360}


def _month_map() -> Column:
    pairs: dict[str, int] = {}
    for names in MONTHS.values():
        for k, name in enumerate(names.split(), 1):
            for n in range(3, len(name) + 1):
                pairs.setdefault(name[:n], k)
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _group(s: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, k), F.lit(""))


def _num(c: Column) -> Column:
    return c.try_cast("int")


_NAME = r"\p{L}{3,}"
_WEEKDAY = r"(?:\p{L}{2,}\.?,\s*)?"
_YMD = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})(?!\d)日?"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?=T)"
_ORDINAL = r"^(\d{4})-(\d{3})(?=T)"
_XXY = r"^(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})(?!\d)"
_DMY_NAME = rf"^{_WEEKDAY}(\d{{1,2}})\.?\s+(?:de\s+)?({_NAME})\.?\s+(?:de\s+)?(\d{{4}})(?!\d)"
_MDY_NAME = rf"^{_WEEKDAY}({_NAME})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)"
_EPOCH = r"^(\d{9,10})(?:\.(\d+))?$"
_EPOCH_MS = r"^(\d{12,13})$"
_TIME = r"^(?:T|[\s,]+)(?:at\s+|à\s+|um\s+|a\s+las\s+)?(\d{1,2})(?:[:h時]|\.(?=\d{2}\s*[ap]\.?m))(\d{2})(?:[:分](\d{2}))?(?:[.,](\d+))?分?\s*([aApP]\.?[mM]\.?)?(?:\s*(?:Uhr|h)\b)?"
_TIME_COMPACT = r"^T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?()"
_OFFSET = r"^(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?(?:\[([^\]]+)\])?$"
_REGION = r"^\[([^\]]+)\]$"
_ABBR = r"^([A-Z]{1,5})$"


def _offset_at(us: Column, zone: Column) -> Column:
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone)) - us


def instants(local_us: Column, zone: Column) -> Column:
    """The UTC instants, none to two, at which a clock in ``zone`` shows ``local_us``."""
    early = local_us - _offset_at(local_us - F.lit(_DAY_US), zone)
    late = local_us - _offset_at(local_us + F.lit(_DAY_US), zone)
    shown = F.filter(F.array(early, late), lambda u: u + _offset_at(u, zone) == local_us)
    return F.when(local_us.isNull() | zone.isNull(), F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(shown)))


def interpretations(spark: SparkSession, df: DataFrame, value: str, zone: str, order: str) -> DataFrame:
    """``df`` with ``cands``: array of (fmt, us, declared) of every valid reading of ``value``.

    ``zone`` (IANA name) and ``order`` (dmy, mdy, ymd) are the source's own. ``declared`` is false for a
    day order the source does not use. No time of day, relative words and impossible values give none.
    """
    zones = list(spark._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    s = F.regexp_replace(F.coalesce(F.col(value), F.lit("")), r"(?U)^[\s:]+|\s+$", "")
    s = F.regexp_replace(s, r"(?iU)^(?:updated|published|posted|last modified|on)\b[\s:]*", "")
    one = df.withColumn("_s", s)
    ymd, compact, ordinal, xxy, dmy, mdy = (_group(F.col("_s"), p, 0) for p in (_YMD, _COMPACT, _ORDINAL, _XXY, _DMY_NAME, _MDY_NAME))
    one = one.withColumn(
        "_kind",
        F.when(F.col("_s").rlike(_EPOCH), "epoch_s").when(F.col("_s").rlike(_EPOCH_MS), "epoch_ms").when(ordinal.isNotNull(), "ordinal")
        .when(compact.isNotNull(), "compact").when(ymd.isNotNull(), "ymd").when(xxy.isNotNull(), "xxy").when(dmy.isNotNull(), "d_name").when(mdy.isNotNull(), "name_d"),
    )
    kind, s = F.col("_kind"), F.col("_s")

    def by_kind(**k: Column) -> Column:
        out = F.lit(None)
        for name, c in k.items():
            out = F.when(kind == name, c).otherwise(out)
        return out

    head = F.coalesce(by_kind(ordinal=ordinal, compact=compact, ymd=ymd, xxy=xxy, d_name=dmy, name_d=mdy), F.lit(""))
    one = one.withColumn("_rest", F.substring(s, F.length(head) + 1, F.length(s)))
    one = one.withColumn("_tp", F.when(F.col("_rest").rlike(_TIME_COMPACT), F.lit(_TIME_COMPACT)).otherwise(F.lit(_TIME)))
    rest = F.col("_rest")

    def time_part(k: int) -> Column:
        return F.when(F.col("_tp") == _TIME_COMPACT, _group(rest, _TIME_COMPACT, k)).otherwise(_group(rest, _TIME, k))

    month = _month_map()
    name = lambda p, k: F.try_element_at(month, F.lower(_group(s, p, k)))
    one = one.select(
        "*",
        by_kind(ymd=_num(_group(s, _YMD, 1)), compact=_num(_group(s, _COMPACT, 1)), ordinal=_num(_group(s, _ORDINAL, 1)), xxy=_num(_group(s, _XXY, 4)), d_name=_num(_group(s, _DMY_NAME, 3)), name_d=_num(_group(s, _MDY_NAME, 3))).alias("_y"),
        by_kind(ymd=_num(_group(s, _YMD, 2)), compact=_num(_group(s, _COMPACT, 2)), ordinal=F.lit(1), xxy=_num(_group(s, _XXY, 3)), d_name=name(_DMY_NAME, 2), name_d=name(_MDY_NAME, 1)).alias("_m"),
        by_kind(ymd=_num(_group(s, _YMD, 3)), compact=_num(_group(s, _COMPACT, 3)), ordinal=F.lit(1), xxy=_num(_group(s, _XXY, 1)), d_name=_num(_group(s, _DMY_NAME, 1)), name_d=_num(_group(s, _MDY_NAME, 2))).alias("_d"),
        by_kind(ordinal=_num(_group(s, _ORDINAL, 2))).alias("_yday"),
        F.when(kind == "xxy", _group(s, _XXY, 2)).alias("_sep"),
        time_part(0).alias("_time"), _num(time_part(1)).alias("_h"), _num(time_part(2)).alias("_mi"), F.coalesce(_num(time_part(3)), F.lit(0)).alias("_sec"),
        F.coalesce(_num(F.rpad(F.substring(time_part(4), 1, 6), 6, "0")), F.lit(0)).alias("_us"), F.lower(F.substring(time_part(5), 1, 1)).alias("_ap"),
    )
    hour = F.when(F.col("_ap").isNull(), F.col("_h")).when(F.col("_h").between(1, 12), F.col("_h") % 12 + F.when(F.col("_ap") == "p", 12).otherwise(0))
    clock = F.when((hour <= 23) & (F.col("_mi") <= 59) & (F.col("_sec") <= 59), (hour.cast("bigint") * 3600 + F.col("_mi") * 60 + F.col("_sec")) * 1_000_000 + F.col("_us"))
    tail = F.regexp_replace(F.substring(rest, F.length("_time") + 1, F.length(rest)), r"^\s+", "")
    one = one.withColumn("_tail", tail).withColumn("_clock", clock)

    def days(y: Column, m: Column, d: Column) -> Column:
        return F.unix_date(F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date"))

    year_days = days(F.col("_y") + 1, F.lit(1), F.lit(1)) - days(F.col("_y"), F.lit(1), F.lit(1))
    first = F.when(kind == "ordinal", F.when(F.col("_yday").between(F.lit(1), year_days), days(F.col("_y"), F.lit(1), F.lit(1)) + F.col("_yday") - 1)).otherwise(days(F.col("_y"), F.col("_m"), F.col("_d")))
    other = F.when(kind == "xxy", days(F.col("_y"), F.col("_d"), F.col("_m")))
    one = one.withColumn("_l1", first.cast("bigint") * _DAY_US + F.col("_clock")).withColumn("_l2", other.cast("bigint") * _DAY_US + F.col("_clock"))
    t = F.col("_tail")
    region = F.coalesce(_group(t, _REGION, 1), F.when(F.col("_tail") == "", F.col(zone)))
    sign = F.when(_group(t, _OFFSET, 1) == "-", -1).otherwise(1)
    minutes = F.when(t.rlike(_OFFSET), sign * (_num(_group(t, _OFFSET, 2)) * 60 + F.coalesce(_num(_group(t, _OFFSET, 3)), F.lit(0))))
    abbr = F.upper(_group(F.upper(t), _ABBR, 1))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    own = F.create_map(*[F.lit(x) for (a, z), m in ABBREVIATIONS_BY_ZONE.items() for x in (f"{a}|{z}", m)])
    minutes = F.coalesce(minutes, F.try_element_at(own, F.concat_ws("|", abbr, F.col(zone))), F.try_element_at(table, abbr))
    one = one.withColumn("_min", F.when(minutes.between(-18 * 60, 18 * 60), minutes)).withColumn("_zone", F.when(region.isin(zones), region))

    def readings(local: str, fmt: Column, declared: Column) -> Column:
        us = F.when(F.col("_min").isNotNull(), F.array(F.col(local) - F.col("_min").cast("bigint") * 60_000_000)).otherwise(instants(F.col(local), F.col("_zone")))
        return F.transform(F.filter(us, lambda u: u.isNotNull()), lambda u: F.struct(fmt.alias("fmt"), u.alias("us"), declared.alias("declared")))

    sort = F.when(F.col("_min").isNotNull(), "offset").when(t == "", "local").otherwise("zone")
    fmt = F.concat_ws(":", kind, F.col("_sep"), sort)
    timed = F.col("_clock").isNotNull()
    day_first = F.coalesce(F.col(order) == "dmy", F.lit(False))
    month_first = F.coalesce(F.col(order) == "mdy", F.lit(False))
    stated = F.coalesce(F.col(order).isin("dmy", "mdy"), F.lit(False))
    empty = F.array().cast("array<struct<fmt:string,us:bigint,declared:boolean>>")
    whole = F.when(kind == "epoch_ms", s.try_cast("bigint") * 1000).when(
        kind == "epoch_s", _group(s, _EPOCH, 1).try_cast("bigint") * 1_000_000 + F.coalesce(F.rpad(F.substring(_group(s, _EPOCH, 2), 1, 6), 6, "0").try_cast("bigint"), F.lit(0))
    )
    cands = (
        F.when(kind.isNull(), empty)
        .when(whole.isNotNull(), F.array(F.struct(kind.alias("fmt"), whole.alias("us"), F.lit(True).alias("declared"))))
        .when(~timed, empty)
        .when((kind == "xxy") & (F.col("_d") == F.col("_m")), readings("_l1", F.concat_ws(":", F.lit("dmy"), fmt), F.lit(True)))
        .when(kind == "xxy", F.concat(readings("_l1", F.concat_ws(":", F.lit("dmy"), fmt), day_first | ~stated), readings("_l2", F.concat_ws(":", F.lit("mdy"), fmt), month_first | ~stated)))
        .otherwise(readings("_l1", fmt, F.lit(True)))
    )
    return one.withColumn("cands", F.coalesce(cands, empty)).select(*df.columns, "cands")


@dataclass(frozen=True)
class Costs:
    """What the chain is charged: for a change of format, a step back in time, a day order the source does not use."""

    switch: float = SWITCH
    backward: float = BACKWARD
    undeclared: float = UNDECLARED

    def step(self, prev: list, cur: list) -> np.ndarray:
        """Cost of every pair of interpretations of neighbours."""
        return np.array([[self.switch * (p["fmt"] != c["fmt"]) + self.backward * (c["us"] < p["us"]) for c in cur] for p in prev])

    def own(self, c: list) -> np.ndarray:
        return np.array([0.0 if x["declared"] else self.undeclared for x in c])


def _in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[list]]:
    """The records of a block in the source's order."""
    pdf = pdf.sort_values("_row", kind="stable")
    return pdf, [list(c) for c in pdf["cands"]]


def _summary(pdf: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    pdf, chain = _in_order(pdf)
    first = chain[0]
    cost = np.where(np.eye(len(first)) > 0, costs.own(first), np.inf)
    prev = first
    for cur in chain[1:]:
        cost = (cost[:, :, None] + costs.step(prev, cur)[None]).min(axis=1) + costs.own(cur)
        prev = cur
    key = pdf.iloc[0]
    return pd.DataFrame({"_src": [key["_src"]], "_block": [key["_block"]], "first": [first], "last": [prev], "cost": [cost.ravel().tolist()]})


def _ends(pdf: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    """Of the blocks of one source: the interpretations that their first and last records take."""
    pdf = pdf.sort_values("_block")
    total, back, prev = None, [], None
    for first, last, cost in zip(pdf["first"], pdf["last"], pdf["cost"], strict=True):
        first, last = list(first), list(last)
        m = np.array(cost).reshape(len(first), len(last))
        if total is None:
            into, frm = np.zeros(len(first)), None
        else:
            step = total[:, None] + costs.step(prev, first)
            into, frm = step.min(axis=0), step.argmin(axis=0)
        through = into[:, None] + m
        back.append((frm, through.argmin(axis=0)))
        total, prev = through.min(axis=0), last
    out, k = [], int(total.argmin())
    for frm, via in reversed(back):
        start = int(via[k])
        out.append((start, k))
        k = int(frm[start]) if frm is not None else 0
    a, b = zip(*reversed(out), strict=True)
    return pd.DataFrame({"_src": pdf["_src"], "_block": pdf["_block"], "start": a, "end": b})


def _decode(pdf: pd.DataFrame, costs: Costs) -> pd.DataFrame:
    pdf, chain = _in_order(pdf)
    cost = np.full(len(chain[0]), np.inf)
    cost[int(pdf["start"].iloc[0])] = 0.0
    back, prev = [], chain[0]
    for cur in chain[1:]:
        step = cost[:, None] + costs.step(prev, cur)
        back.append(step.argmin(axis=0))
        cost, prev = step.min(axis=0) + costs.own(cur), cur
    k = int(pdf["end"].iloc[0])
    picks = [k]
    for b in reversed(back):
        k = int(b[k])
        picks.append(k)
    picks.reverse()
    declared = [{x["us"] for x in c if x["declared"]} for c in chain]
    return pd.DataFrame({
        "_id": pdf["_id"].to_numpy(), "us": [c[k]["us"] for c, k in zip(chain, picks, strict=True)], "fmt": [c[k]["fmt"] for c, k in zip(chain, picks, strict=True)],
        "n": [len(c) for c in chain], "fixed": [len(x) == 1 for x in declared],
    })


def normalise(spark: SparkSession, records: DataFrame, sources: DataFrame, id_col: str = "article_id", source_col: str = "domain", value_col: str = "date", at_col: str = "fetched_at", zone_col: str = "time_zone", order_col: str = "date_order", costs: Costs = Costs()) -> DataFrame:
    """(<id_col>, utc_us, fmt, n_readings, fixed): a row per record with at least one valid interpretation.

    utc_us is the reading Viterbi chose, in microseconds since 1970-01-01 UTC, finer digits dropped;
    ``fixed`` says that it is the only valid one under the source's declared zone and order. Null or
    senseless values give no row; a source missing from ``sources`` has no zone and no order; of repeated
    ids each row counts; records with equal times are ordered by id. Other columns are left aside.
    """
    src = sources.groupBy(F.col(source_col).alias("_src")).agg(F.min(zone_col).alias("_tz"), F.min(order_col).alias("_ord"))
    base = records.filter(F.trim(F.coalesce(F.col(value_col), F.lit(""))) != "").select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col), F.lit("")).alias("_src"), F.col(value_col).alias("_value"), F.coalesce(F.unix_micros(F.col(at_col)), F.lit(0)).alias("_at")
    )
    # sorted before they are read: the sort samples its input, which would read every value twice
    placed = base.join(src, "_src", "left").orderBy("_src", "_at", "_id").withColumn("_row", F.monotonically_increasing_id())
    read = interpretations(spark, placed, "_value", "_tz", "_ord")
    # a row's number begins with its partition's, so a block never reaches over two partitions
    chain = cut_lineage(read.select("_id", "_src", "_row", "cands")).filter(F.size("cands") > 0).withColumn("_block", F.floor(F.col("_row") / BLOCK_ROWS))
    cand = "array<struct<fmt:string,us:bigint,declared:boolean>>"
    id_type = chain.schema["_id"].dataType.simpleString()
    sums = chain.groupBy("_src", "_block").applyInPandas(lambda pdf: _summary(pdf, costs), f"_src string, _block bigint, first {cand}, last {cand}, cost array<double>")
    ends = sums.groupBy("_src").applyInPandas(lambda pdf: _ends(pdf, costs), "_src string, _block bigint, start int, end int")
    chosen = chain.join(ends, ["_src", "_block"]).groupBy("_src", "_block").applyInPandas(lambda pdf: _decode(pdf, costs), f"_id {id_type}, us bigint, fmt string, n int, fixed boolean")
    return chosen.select(F.col("_id").alias(id_col), F.col("us").alias("utc_us"), "fmt", F.col("n").alias("n_readings"), "fixed")
