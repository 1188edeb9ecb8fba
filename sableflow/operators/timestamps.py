"""One UTC instant for timestamps in mixed formats, precisions and zones.

Every value is parsed under every form it fits. A form that fixes zone and order has one reading; an all-numeric date
has one for each order of day, month and year that gives a valid date: two with a four-digit year, three with a
two-digit one. What a source means by them is a mixture of orders, fitted by expectation-maximisation: a value counts
for each valid reading by the order's share in the source times the likelihood of the reading itself, which is how
often readings that are certain lie as far from the row's reference time (when it was received or created) as this one
does. The shares start from a few pseudo-counts of the declared order and are iterated until they don't change. The
posterior of a value then chooses its reading; readings of one instant count together, and where no instant reaches
`sure`, the value is marked ambiguous and has none.

The fit needs, per source, counts of patterns (which orders are valid, and how far off each is), 216 at most, which are
aggregated before the shuffle, so neither a source with a third of all rows nor a large number of sources gathers rows
anywhere. Values are parsed once, and the parsed rows are written to the shared folder for the fit and the choice.

Defined results (column `status`): "ok" has an instant; "normal" is written as YYYY-MM-DDTHH:MM:SS[.fraction]Z already
(with an instant too); "none" is null, empty or no instant; "no_zone" is a wall-clock reading whose source has no known
zone; "skipped" is a wall-clock reading that the zone's clocks left out; "ambiguous" see above. A reading that occurs
twice is the earlier instant; two-digit years from 69 on are of the last century. Repeated rows come out as often as
they came in; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sableflow.functions.joins import join_small
from sableflow.session import cut, saved

# Month names as written in the feeds' languages.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "en3": "jan feb mar apr may jun jul aug sep oct nov dec",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "hi": "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर",
    "ar": "يناير فبراير مارس أبريل مايو يونيو يوليو أغسطس سبتمبر أكتوبر نوفمبر ديسمبر",
}
_MONTH = {name: i + 1 for names in MONTHS.values() for i, name in enumerate(names.split())} | {"sept": 9, "setiembre": 9, "marco": 3}
# Zone abbreviations in minutes from UTC, by the zone that uses them.
ABBREVIATIONS = {
    "America/New_York": {"EST": -300, "EDT": -240}, "America/Chicago": {"CST": -360, "CDT": -300}, "America/Sao_Paulo": {"BRT": -180, "BRST": -120},
    "America/Bogota": {"COT": -300}, "Europe/Lisbon": {"WET": 0, "WEST": 60}, "Europe/London": {"GMT": 0, "BST": 60},
    "Europe/Paris": {"CET": 60, "CEST": 120}, "Europe/Madrid": {"CET": 60, "CEST": 120}, "Europe/Berlin": {"CET": 60, "CEST": 120},
    "Europe/Moscow": {"MSK": 180}, "Asia/Dubai": {"GST": 240}, "Asia/Kolkata": {"IST": 330}, "Asia/Shanghai": {"CST": 480},
    "Asia/Tokyo": {"JST": 540}, "Australia/Sydney": {"AEST": 600, "AEDT": 660},
}

NORMAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"
_TIME = r"(?:\D{0,6}?(?P<h>\d{1,2})\s*(?:(?:[:hH.]|時|时|点)\s*(?P<mi>\d\d)\s*(?:分|:(?P<s>\d\d)(?:[.,](?P<f>\d{1,9}))?)?|(?=[AaPp]\.?[Mm])))?"
_ZONE = r"\s*(?:Uhr\s*)?(?P<ap>[AaPp]\.?[Mm]\.?)?\s*(?P<z>Z|z|(?:UTC|GMT)?[+-]\d\d:?\d\d|[A-Z]{2,5})?\s*(?:\[(?P<region>[^\]]+)\])?$"
_FORMS = [
    ("ymd", re.compile(r"^(?P<y>\d{4})[-/.](?P<mo>\d\d)[-/.](?P<d>\d\d)" + _TIME + _ZONE)),
    ("ymd", re.compile(r"^(?P<y>\d{4})(?P<mo>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:\.(?P<f>\d{1,9}))?" + _ZONE)),
    ("ymd", re.compile(r"^(?P<y>\d{4})年(?P<mo>\d{1,2})月(?P<d>\d{1,2})日" + _TIME + _ZONE)),
    ("week", re.compile(r"^(?P<y>\d{4})-?W(?P<w>\d\d)-?(?P<wd>[1-7])" + _TIME + _ZONE)),
    ("num", re.compile(r"^(?P<a>\d{1,2})[/.-](?P<b>\d{1,2})[/.-](?P<c>\d{4}|\d\d)(?!\d)" + _TIME + _ZONE)),
    ("name", re.compile(r"^(?:\w+,\s*)?(?P<d>\d{1,2})\.?\s+(?:de\s+)?(?P<name>[^\W\d_]{3,})\.?,?\s+(?:de\s+)?(?P<y>\d{4})" + _TIME + _ZONE)),
    ("name", re.compile(r"^(?:\w+,\s*)?(?P<name>[^\W\d_]{3,})\.?\s+(?P<d>\d{1,2}),?\s+(?P<y>\d{4})" + _TIME + _ZONE)),
]
_SECONDS = re.compile(r"^(\d{10})\.(\d{1,9})$")
_EPOCH = {10: (1_000_000, 1), 13: (1_000, 1), 16: (1, 1), 19: (1, 1_000)}  # digits: microseconds are the number times the first by the second
ORDERS = ("DMY", "MDY", "YMD")
_ZERO = datetime(1970, 1, 1)


@lru_cache(4096)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


def _micros(t: datetime) -> int:
    return (t - _ZERO) // timedelta(microseconds=1)


def _instant(m: dict, mo: int, d: int, zone: str | None) -> tuple[int | None, str]:
    """The instant of the matched fields, or why there is none."""
    try:
        h, ap = int(m.get("h") or 0), (m.get("ap") or "").upper().replace(".", "")
        if ap:
            if not 1 <= h <= 12:
                return None, "none"
            h = h % 12 + 12 * (ap == "PM")
        wall = datetime(int(m["y"]), mo, d, h, int(m.get("mi") or 0), int(m.get("s") or 0), int(((m.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None, "none"
    z = m.get("z")
    if z and (z in "Zz" or z in ("UTC", "GMT", "UT")):
        return _micros(wall), "ok"
    if z and (z[0] in "+-" or z[:3] in ("UTC", "GMT")):
        z = z.removeprefix("UTC").removeprefix("GMT")
        minutes = int(z[1:3]) * 60 + int(z[-2:])
        return _micros(wall) + (1 if z[0] == "-" else -1) * minutes * 60_000_000, "ok"
    tz = _zone(m.get("region") or zone)
    if z:
        own = ABBREVIATIONS.get(zone or "", {}).get(z)
        if own is None and tz:
            own = next((round(t.utcoffset().total_seconds() / 60) for t in (wall.replace(tzinfo=tz), wall.replace(tzinfo=tz, fold=1)) if t.tzname() == z), None)
        if own is None and len(all_of := {x[z] for x in ABBREVIATIONS.values() if z in x}) == 1:
            own = all_of.pop()
        return (None, "no_zone") if own is None else (_micros(wall) - own * 60_000_000, "ok")
    if tz is None:
        return None, "no_zone"
    at = wall.replace(tzinfo=tz).astimezone(timezone.utc)  # fold 0: of two, the earlier
    if at.astimezone(tz).replace(tzinfo=None) != wall:
        return None, "skipped"
    return _micros(at.replace(tzinfo=None)), "ok"


@lru_cache(50_000)
def readings(value: str, zone: str | None) -> tuple[str, tuple[tuple[int | None, str], ...]]:
    """(kind, readings): one reading, or, for kind "num", one for each of ORDERS ("none" where it gives no date)."""
    none = ((None, "none"),)
    v = value.strip()
    if v.isascii() and v.isdigit():
        by = _EPOCH.get(len(v))
        return "one", ((int(v) * by[0] // by[1], "ok"),) if by else none
    if m := _SECONDS.match(v):
        return "one", ((int(m[1]) * 1_000_000 + int((m[2] + "000000")[:6]), "ok"),)
    for kind, form in _FORMS:
        if not (found := form.match(v)):
            continue
        m = found.groupdict()
        if kind == "num":
            x, y, z = int(m["a"]), int(m["b"]), int(m["c"])
            long = len(m["c"]) == 4
            orders = ((z, y, x), (z, x, y), (x, y, z))  # year, month, day
            return "num", tuple(_instant(m | {"y": o[0] if long else _century(o[0])}, o[1], o[2], zone) if k < 2 or not long else none[0] for k, o in enumerate(orders))
        if kind == "week":
            try:
                day = datetime.fromisocalendar(int(m["y"]), int(m["w"]), int(m["wd"]))
            except ValueError:
                return "one", none
            return "one", (_instant(m | {"y": day.year}, day.month, day.day, zone),)
        mo = int(m["mo"]) if kind == "ymd" else _MONTH.get(m["name"].lower(), 0)
        if mo:
            return "one", (_instant(m, mo, int(m["d"]), zone),)
    return "one", none


def _century(y: int) -> int:
    return y + (1900 if y >= 69 else 2000)


_DAY = 86_400_000_000
_BINS = 5  # 0: no reference; else by the time from the reading to the reference


def _bin(us: int | None, near: int | None) -> int:
    if us is None or near is None:
        return 0
    lag = near - us
    return 1 if lag < -_DAY else 2 if lag <= 2 * _DAY else 3 if lag <= 60 * _DAY else 4


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        kinds, us, statuses, bins = [], [[], [], []], [[], [], []], [[], [], []]
        for v, z, near in zip(df["value"], df["zone"], df["near"].astype("object").where(df["near"].notna(), None), strict=True):
            kind, found = readings(v, z) if v is not None else ("one", ((None, "none"),))
            kinds.append(kind)
            for k in range(3):
                u, why = found[k] if k < len(found) else (None, "none")
                us[k].append(u)
                statuses[k].append(why)
                bins[k].append(-1 if why == "none" else _bin(u, near))
        out = {"tbl": df["tbl"], "row_no": df["row_no"], "src": df["src"], "value": df["value"], "declared": df["declared"], "kind": kinds}
        for k in range(3):
            out |= {f"us_{k}": pd.array(us[k], "Int64"), f"status_{k}": statuses[k], f"bin_{k}": bins[k]}
        yield pd.DataFrame(out)


_PARSED = "tbl string, row_no bigint, src string, value string, declared string, kind string, " + ", ".join(f"us_{k} bigint, status_{k} string, bin_{k} int" for k in range(3))


def mixture(valid: np.ndarray, n: np.ndarray, prior: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """Shares of the orders by expectation-maximisation: valid[k, o] is the likelihood of pattern k under order o (0: no date), n its count."""
    total = prior.sum() + n.sum()
    shares = prior / prior.sum()
    while True:
        joint = valid * shares
        expected = (n[:, None] * joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)).sum(axis=0)
        now = (prior + expected) / total
        if np.abs(now - shares).max() < tolerance:
            return now / now.sum()
        shares = now


def fit_orders(parsed: DataFrame, declared_weight: float = 5.0, declared_share: float = 0.95) -> tuple[DataFrame, list[float]]:
    """(src, share_0, share_1, share_2), and the likelihood of each bin of lags.

    declared_weight: the pseudo-counts of a source whose order is declared, of which the declared one has declared_share;
    a source without has one, dealt out evenly.
    """
    names = [f"bin_{k}" for k in range(3)]
    counts = parsed.where("kind = 'num'").groupBy("src", *names).agg(F.count("*").alias("n"), F.max("declared").alias("declared"))
    counts = cut(counts)
    certain = [F.col(c) for c in names]
    only = F.when(F.size(F.filter(F.array(*certain), lambda b: b >= 0)) == 1, F.array_max(F.array(*certain)))
    seen = {r.bin: r.n for r in counts.select(only.alias("bin"), "n").where("bin > 0").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    all_of = sum(seen.values()) + 1.0 * (_BINS - 1)
    likely = [1.0] + [(seen.get(b, 0) + 1.0) / all_of for b in range(1, _BINS)]

    def of(df: pd.DataFrame) -> pd.DataFrame:
        told = next((d for d in df["declared"] if d in ORDERS), None)
        prior = np.full(3, 1 / 3) if told is None else np.where(np.array(ORDERS) == told, declared_share, (1 - declared_share) / 2) * declared_weight
        bins = df[names].to_numpy()
        shares = mixture(np.where(bins < 0, 0.0, np.array(likely)[np.maximum(bins, 0)]), df["n"].to_numpy(float), prior)
        return pd.DataFrame({"src": [df["src"].iloc[0]], **{f"share_{k}": [shares[k]] for k in range(3)}})

    return cut(counts.groupBy("src").applyInPandas(of, "src string, share_0 double, share_1 double, share_2 double")), likely


def normalise(rows: DataFrame, feeds: DataFrame, sure: float = 0.9) -> DataFrame:
    """rows: tbl, row_no, value, source, site_id (both may be null), and, if there is one, near (a timestamp); feeds: source, site_id, zone_name, date_order.

    Gives tbl, row_no, value, utc_us, status, posterior. A row without source takes the one of its site.
    """
    known = feeds.where("source is not null").dropDuplicates(["source"])
    by_name = known.select(F.trim("source").alias("src_name"), F.col("zone_name").alias("z1"), F.col("date_order").alias("o1"))
    by_site = feeds.where("site_id is not null").dropDuplicates(["site_id"]).select(
        F.col("site_id").cast("string").alias("site"), F.trim("source").alias("s2"), F.col("zone_name").alias("z2"), F.col("date_order").alias("o2")
    )
    near = F.unix_micros(F.col("near").cast("timestamp")) if "near" in rows.columns else F.lit(None).cast("bigint")
    x = rows.select("tbl", "row_no", "value", F.nullif(F.trim("source"), F.lit("")).alias("src_name"), F.col("site_id").cast("string").alias("site"), near.alias("near"))
    x = join_small(join_small(x, by_name, ["src_name"]), by_site, ["site"])
    x = x.select("tbl", "row_no", "value", F.coalesce("src_name", "s2").alias("src"), F.coalesce("z1", "z2").alias("zone"), F.coalesce("o1", "o2").alias("declared"), "near")
    parsed = saved(x.mapInPandas(_parsed, _PARSED))
    orders, likely = fit_orders(parsed)
    out = join_small(parsed, orders, ["src"])
    likelihood = F.array(*(F.lit(p) for p in likely))
    weight = [F.when(F.col(f"bin_{k}") >= 0, F.coalesce(f"share_{k}", F.lit(1 / 3)) * F.element_at(likelihood, F.col(f"bin_{k}") + 1)).otherwise(0.0) for k in range(3)]
    out = out.withColumns({f"w_{k}": w for k, w in enumerate(weight)})
    total = F.col("w_0") + F.col("w_1") + F.col("w_2")

    def together(k: int) -> Column:
        same = [F.when(F.col(f"us_{j}").eqNullSafe(F.col(f"us_{k}")) & (F.col(f"status_{j}") == F.col(f"status_{k}")), F.col(f"w_{j}")).otherwise(0.0) for j in range(3)]
        return F.when(total > 0, (same[0] + same[1] + same[2]) / total).otherwise(0.0)

    out = out.withColumns({f"q_{k}": together(k) for k in range(3)})
    best = F.greatest("q_0", "q_1", "q_2")
    single = F.col("kind") == "one"
    chosen = F.when(single | (F.col("q_0") == best), 0).when(F.col("q_1") == best, 1).otherwise(2)
    told = single | (best >= sure) | (total == 0)
    us, status = (F.element_at(F.array(*(f"{c}_{k}" for k in range(3))), chosen + 1) for c in ("us", "status"))
    return out.select(
        "tbl", "row_no", "value", F.when(told, us).alias("utc_us"),
        F.when(F.col("value").rlike(NORMAL) & (F.col("status_0") == "ok"), "normal").when(told, status).otherwise("ambiguous").alias("status"),
        F.when(single | (total == 0), 1.0).otherwise(best).alias("posterior"),
    )


def stated_times(news: DataFrame | None, sot: DataFrame | None, oil: DataFrame | None) -> DataFrame:
    """The written times of the three tables in the shape that normalise() takes."""
    parts = []
    if news is not None:
        parts.append(news.select(F.lit("news").alias("tbl"), F.col("news_no").alias("row_no"), F.col("datetime").alias("value"), "source", F.get_json_object("metadata", "$.site_id").alias("site_id"), F.col("created_at").alias("near")))
    none = F.lit(None).cast("string").alias("site_id")
    if sot is not None:
        parts.append(sot.select(F.lit("sot_sugar").alias("tbl"), F.col("sot_no").alias("row_no"), F.col("timestamp_created").alias("value"), "source", none, F.col("timestamp_added").alias("near")))
    if oil is not None:
        parts.append(oil.select(F.lit("oil_only_output").alias("tbl"), F.col("oil_no").alias("row_no"), F.col("datetime").alias("value"), "source", none, F.lit(None).cast("timestamp_ntz").alias("near")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
