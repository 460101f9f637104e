"""Queries of the detectors and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RULES
from ..functions.scalar import account_form, phone_form
from ..operators import patterns as P
from ..operators.chains import path_totals, paths_for_texts, rapid_paths
from ..session import cut
from ..sources.casedata import calls, parties, transfers, vertices, with_tables
from ..tables import table


def _parties(spark, folder):
    return parties(calls(spark, folder))


def rolling_spike(spark: SparkSession, folder: str) -> DataFrame:
    return P.communication_spikes(_parties(spark, folder))


def freq_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    return P.frequency_anomalies(transfers(spark, folder))


def burst_score(spark: SparkSession, folder: str) -> DataFrame:
    return P.burst_scores(_parties(spark, folder))


def large_single(spark: SparkSession, folder: str) -> DataFrame:
    return P.large_singles(transfers(spark, folder))


def fan_in_shared(spark: SparkSession, folder: str) -> DataFrame:
    return P.fan_in(transfers(spark, folder))


def _incidents(spark: SparkSession, folder: str) -> DataFrame:
    """The days on which most case files were filed: one per month."""
    filed = spark.read.parquet(f"{folder}/documents.parquet").select(F.to_date("filed_at").alias("incident")).dropna()
    per_day = filed.groupBy("incident").agg(F.count(F.lit(1)).alias("n"))
    return per_day.groupBy(F.date_format("incident", "yyyy-MM").alias("month")).agg(F.max(F.struct("n", "incident")).alias("m")).select(F.col("m.incident").alias("incident"))


def incident_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return P.incident_clusters(_parties(spark, folder), _incidents(spark, folder))


def off_hour_motif(spark: SparkSession, folder: str) -> DataFrame:
    return P.off_hour_motifs(_parties(spark, folder))


def late_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return P.late_ratios(_parties(spark, folder))


def call_profile(spark: SparkSession, folder: str) -> DataFrame:
    return P.call_profiles(calls(spark, folder))


def txn_profile(spark: SparkSession, folder: str) -> DataFrame:
    return P.transfer_profiles(transfers(spark, folder))


def counterparty_degree(spark: SparkSession, folder: str) -> DataFrame:
    return P.counterparty_degrees(calls(spark, folder), "caller", "callee")


def colocation(spark: SparkSession, folder: str) -> DataFrame:
    return P.colocations(_parties(spark, folder))


def _record_flags(spark: SparkSession, folder: str, c: DataFrame, t: DataFrame) -> DataFrame:
    """The flags of every phone and account by the rules over calls and transfers but fund paths."""
    p = parties(c)
    return P.flags(
        (P.communication_spikes(p), "phone", "COMMUNICATION_SPIKE", F.format_string("%d calls within 24 hours", "peak")),
        (P.frequency_anomalies(t), "src", "HIGH_TRANSACTION_FREQUENCY", F.format_string("%d transfers within 24 hours", "peak")),
        (P.large_singles(t), "src", "HIGH_TRANSACTION_FREQUENCY", F.format_string("large transfer %s", "txn_id")),
        (P.fan_in(t), "dst", "MULTI_SUSPECT_SHARED_ACCOUNT", F.format_string("%d senders", "n_senders")),
        (P.incident_clusters(p, _incidents(spark, folder)), "phone", "INCIDENT_TIMING_CLUSTER", F.format_string("%d calls around %s", "n_calls", F.col("incident").cast("string"))),
    )


def key_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The flags of every phone and account by all rules over calls and transfers, fund paths included."""
    c, t = cut(calls(spark, folder)), cut(transfers(spark, folder))
    return _with_paths(_record_flags(spark, folder, c, t), rapid_paths(t, RULES.chain_hours, RULES.chain_hops))


def _with_paths(found: DataFrame, paths: DataFrame) -> DataFrame:
    paths = paths.withColumn("key", F.explode(F.split("accounts", ",")))
    return found.unionByName(P.flags((paths, "key", "RAPID_FUND_MOVEMENT", F.concat(F.lit("fund path through "), "accounts"))))


def key_totals(spark: SparkSession, folder: str) -> DataFrame:
    """``flag_ranking`` without the evidence; fund paths are counted, not listed."""
    c, t = cut(calls(spark, folder)), cut(transfers(spark, folder))
    paths = path_totals(t, RULES.chain_hours, RULES.chain_hops).withColumn("flag", F.lit("RAPID_FUND_MOVEMENT"))
    return P.flag_totals(_record_flags(spark, folder, c, t), paths)


def flag_ranking(spark: SparkSession, folder: str) -> DataFrame:
    c, t = cut(calls(spark, folder)), cut(transfers(spark, folder))
    paths = paths_for_texts(t, RULES.chain_hours, RULES.chain_hops, "RAPID_FUND_MOVEMENT: fund path through ")
    return P.flag_ranking(_with_paths(_record_flags(spark, folder, c, t), paths))


def carriers(spark: SparkSession, folder: str) -> DataFrame:
    """``entity_id, type, key``: the entities that carry a phone or account, and the subscribers who own one."""
    listed = vertices(spark, folder).filter("type IN ('PHONE', 'ACCOUNT')").select(
        "entity_id", "type", F.when(F.col("type") == "PHONE", phone_form(F.col("name"))).otherwise(account_form(F.col("name"))).alias("key")
    )
    people = table(spark, folder, "subscribers", "person_id", "phone", "account")
    owners = people.select(F.col("person_id").alias("entity_id"), F.lit("PERSON").alias("type"), F.explode(F.array_compact(F.array("phone", "account"))).alias("key"))
    return listed.unionByName(owners).filter("key IS NOT NULL AND entity_id IS NOT NULL").distinct()


def flagged_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged phones and accounts with the entities that carry them and the subscribers who own them."""
    kinds = carriers(spark, folder)
    return key_totals(spark, folder).join(kinds, "key").select("entity_id", "type", "key", "flags", "n_flags", "flag_score")


def person_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Per subscriber the parts of the risk, each the largest over the person's phones or accounts, and what they rest on."""
    people = table(spark, folder, "subscribers", "person_id", "full_name", "phone", "account").dropna(subset=["person_id", "full_name"])
    c, t = cut(calls(spark, folder)), cut(transfers(spark, folder))
    p = cut(parties(c))
    known = people.select("phone").dropna().distinct()
    night = p.groupBy(F.col("phone").alias("key")).agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.hour("ts") < 6).alias("n_late"), F.min("call_id").alias("first_call"))
    by_phone = (
        people.select("person_id", "full_name", F.col("phone").alias("key")).dropna().distinct()
        .join(night, "key", "left")
        .join(P.burst_scores(p).select(F.col("phone").alias("key"), "burst"), "key", "left")
        .join(P.known_colocations(c, known).select(F.col("phone").alias("key"), "colocation"), "key", "left")
        .join(P.call_profiles(c).select(F.col("caller").alias("key"), "call_score"), "key", "left")
        .withColumn("temporal", F.least(0.6 * F.coalesce(F.col("n_late") / F.col("n_calls"), F.lit(0.0)) + 0.4 * F.coalesce("burst", F.lit(0.0)), F.lit(1.0)))
        .groupBy("person_id", "full_name").agg(
            *(F.max(F.coalesce(x, F.lit(0.0))).alias(x) for x in ("temporal", "colocation", "call_score")),
            F.sum(F.coalesce("n_calls", F.lit(0))).alias("n_calls"), F.sum(F.coalesce("n_late", F.lit(0))).alias("n_late"), F.min("first_call").alias("first_call"),
        )
    )
    sides = t.select(F.explode(F.array_distinct(F.array_compact(F.array("src", "dst")))).alias("key"), "txn_id")
    by_account = (
        people.select("person_id", F.col("account").alias("key")).dropna().distinct()
        .join(P.transfer_profiles(t).select(F.col("account").alias("key"), "txn_score", "n_transfers", "n_large", "total"), "key")
        .join(sides.groupBy("key").agg(F.min("txn_id").alias("first_txn")), "key", "left")
        .groupBy("person_id").agg(F.max("txn_score").alias("txn_score"), F.sum("n_transfers").alias("n_transfers"), F.sum("n_large").alias("n_large"), F.sum(F.col("total").cast("decimal(20,2)")).alias("total"), F.min("first_txn").alias("first_txn"))
    )
    # counterparties of all phones and accounts of a person over all numbers and accounts but one
    keys = people.select("person_id", F.explode(F.array_compact(F.array("phone", "account"))).alias("key")).distinct()
    ends = c.select(F.col("caller").alias("key"), F.col("callee").alias("other")).unionByName(t.select(F.col("src").alias("key"), F.col("dst").alias("other")))
    ways = ends.unionByName(ends.select(F.col("other").alias("key"), F.col("key").alias("other"))).filter("key IS NOT NULL AND other IS NOT NULL AND key <> other").distinct()
    met = ways.join(keys, "key").groupBy("person_id").agg(F.countDistinct("other").alias("n_parties"))
    total = ends.select(F.explode(F.array("key", "other")).alias("x")).dropna().agg(F.countDistinct("x").alias("n_all"))  # one row
    scored = by_phone.join(by_account, "person_id", "left").join(met, "person_id", "left").crossJoin(F.broadcast(total))
    return scored.select(
        "person_id", "full_name", F.least(F.coalesce("n_parties", F.lit(0)) / F.greatest(F.col("n_all") - 1, F.lit(1)), F.lit(1.0)).alias("degree"), "temporal", "colocation", "call_score",
        F.coalesce("txn_score", F.lit(0.0)).alias("txn_score"), "n_calls", "n_late", "first_call", F.coalesce("n_transfers", F.lit(0)).alias("n_transfers"), F.coalesce("n_large", F.lit(0)).alias("n_large"),
        F.coalesce("total", F.lit(0)).cast("double").alias("total"), "first_txn",
    )


def risk_topn(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty subscribers of highest risk, with a reason in three points and the first records they rest on."""
    parts = ((RULES.risk_degree, "degree"), (RULES.risk_temporal, "temporal"), (RULES.risk_colocation, "colocation"), (RULES.risk_calls, "call_score"), (RULES.risk_transfers, "txn_score"))
    risk = 100 * sum(w * F.col(c) for w, c in parts)
    points = F.concat(
        F.format_string("1) %d calls, %d between midnight and six (see %s). ", "n_calls", "n_late", F.coalesce("first_call", F.lit("none"))),
        F.format_string("2) %d transfers of %.0f in all, %d above 100000 (see %s). ", "n_transfers", "total", "n_large", F.coalesce("first_txn", F.lit("none"))),
        F.format_string("3) co-location %.2f, calls %.2f", "colocation", "call_score"),
    )
    scored = person_scores(spark, folder).withColumn("risk", F.round(risk, 1))
    return scored.orderBy(F.desc("risk"), "person_id").limit(20).select("person_id", "full_name", "risk", points.alias("reason"))


def light_risk(spark: SparkSession, folder: str) -> DataFrame:
    """The three subscribers of highest light risk: contacts, calls from 23 to 4 o'clock and money moved, by person."""
    people = table(spark, folder, "subscribers", "person_id", "full_name", "phone", "account").dropna(subset=["person_id", "full_name"])
    c, t = cut(calls(spark, folder)), transfers(spark, folder)
    n_people = people.agg(F.countDistinct("person_id").alias("n_people"))  # one row
    phones = people.select("person_id", F.col("phone")).dropna().distinct()
    late = F.hour("ts").isin(23, 0, 1, 2, 3, 4)
    seat = c.select(F.col("caller").alias("phone"), F.col("callee").alias("other"), "call_id", late.alias("late")).unionByName(c.select(F.col("callee").alias("phone"), F.col("caller").alias("other"), "call_id", late.alias("late")))
    called = seat.filter("phone IS NOT NULL").join(phones, "phone").groupBy("person_id").agg(F.countDistinct("other").alias("n_contacts"), F.countDistinct("call_id").alias("n_calls"), F.countDistinct(F.when(F.col("late"), F.col("call_id"))).alias("n_late"))
    accounts = people.select("person_id", F.col("account")).dropna().distinct()
    sides = t.select(F.col("src").alias("account"), "amount").unionByName(t.select(F.col("dst").alias("account"), "amount"))
    moved = sides.join(accounts, "account").groupBy("person_id").agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))
    joined = people.groupBy("person_id").agg(F.min("full_name").alias("full_name")).join(called, "person_id", "left").join(moved, "person_id", "left").crossJoin(F.broadcast(n_people))
    zero = lambda c: F.coalesce(c, F.lit(0))
    contacts = F.least(zero("n_contacts") / F.greatest("n_people", F.lit(1)), F.lit(1.0))
    nights = zero("n_late") / F.greatest(zero("n_calls"), F.lit(1))
    money = F.least(F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / 5_000_000, F.lit(1.0))
    scored = joined.withColumn("risk", F.round(100 * (0.30 * contacts + 0.25 * nights + 0.45 * money), 2))
    return scored.orderBy(F.desc("risk"), "person_id").limit(3).select("person_id", "full_name", "risk")


QUERIES = {
    f.__name__: f
    for f in (
        rolling_spike, freq_anomaly, burst_score, large_single, fan_in_shared, incident_cluster, off_hour_motif, late_ratio, call_profile, txn_profile,
        counterparty_degree, colocation, flag_ranking, flagged_entities, risk_topn, light_risk,
    )
}

_P, _T = ("calls", "parties"), ("transfers",)
_SPIKE = "SELECT phone, max(n) AS peak FROM (SELECT phone, count(*) OVER (PARTITION BY phone ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING) AS n FROM parties) GROUP BY phone HAVING max(n) >= 5"
_FREQ = """SELECT src, max(n) AS peak, round(avg(n), 6) AS mean_count FROM (
  SELECT src, count(*) OVER (PARTITION BY src ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 24 HOUR FOLLOWING)
    - (row_number() OVER (PARTITION BY src ORDER BY ts, txn_id) - rank() OVER (PARTITION BY src ORDER BY ts)) AS n FROM transfers WHERE src IS NOT NULL)
GROUP BY src HAVING max(n) >= 3 AND max(n) >= 2.5 * avg(n)"""
_BURST = "SELECT phone, max(n) AS peak, round(least(max(n) / 5, 1.0), 4) AS burst FROM (SELECT phone, count(*) OVER (PARTITION BY phone ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 2 HOUR FOLLOWING) AS n FROM parties) GROUP BY phone"
_LARGE = "SELECT src, ts, txn_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, txn_id) AS k FROM transfers WHERE amount >= 150000 AND src IS NOT NULL) WHERE k = 1 UNION ALL SELECT src, ts, txn_id, amount FROM (SELECT *, row_number() OVER (ORDER BY ts, txn_id) AS k FROM transfers WHERE amount >= 150000 AND src IS NULL) WHERE k = 1"
_FAN = "SELECT dst, count(DISTINCT src) AS n_senders, count(*) AS n_transfers FROM transfers WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY dst HAVING count(DISTINCT src) >= 3"
_INCIDENTS = "incidents AS (SELECT arg_max(d, (n, d)) AS incident FROM (SELECT CAST(filed_at AS DATE) AS d, count(*) AS n FROM documents WHERE filed_at IS NOT NULL GROUP BY 1) GROUP BY strftime(d, '%Y-%m'))"
_CLUSTER = "SELECT p.phone, i.incident, count(*) AS n_calls FROM parties p JOIN incidents i ON p.ts >= CAST(i.incident AS TIMESTAMP) - INTERVAL 3 DAY AND p.ts <= CAST(i.incident AS TIMESTAMP) + INTERVAL 3 DAY GROUP BY ALL HAVING count(*) >= 2"
_LATE = "SELECT phone, round(avg(CASE WHEN hour(ts) < 6 THEN 1 ELSE 0 END), 6) AS late_ratio, count(*) AS n_calls FROM parties GROUP BY phone"
_CALLS = """SELECT caller, CAST(sum(n) AS BIGINT) AS n_calls, max(CASE WHEN callee IS NOT NULL THEN n END) AS most_repeated, CAST(sum(s) AS BIGINT) AS n_short,
  round(0.4 * least(sum(n) / 30, 1.0) + 0.4 * least(coalesce(max(CASE WHEN callee IS NOT NULL THEN n END), 0) / 5, 1.0) + 0.2 * sum(s) / sum(n), 4) AS call_score
FROM (SELECT caller, callee, count(*) AS n, count(*) FILTER (WHERE duration_s < 30) AS s FROM calls WHERE caller IS NOT NULL GROUP BY 1, 2) GROUP BY caller"""
_TXN = """SELECT account, count(*) AS n_transfers, count(*) FILTER (WHERE amount > 100000) AS n_large, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total, count(DISTINCT other) AS n_parties,
  round(0.25 * least(count(*) / 15, 1.0) + 0.30 * least(count(*) FILTER (WHERE amount > 100000) / 3, 1.0)
    + 0.25 * least(greatest(coalesce(CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE), 0.0), 0.0) / 500000, 1.0) + 0.20 * least(count(DISTINCT other) / 8, 1.0), 4) AS txn_score
FROM (SELECT src AS account, dst AS other, amount FROM transfers UNION ALL SELECT dst, src, amount FROM transfers WHERE src IS DISTINCT FROM dst) WHERE account IS NOT NULL GROUP BY account"""
_DEGREE = """SELECT node, count(DISTINCT other) AS n_parties, round(count(DISTINCT other) / greatest((SELECT count(DISTINCT x) FROM (SELECT caller AS x FROM calls UNION ALL SELECT callee FROM calls)) - 1, 1), 6) AS degree
FROM (SELECT caller AS node, callee AS other FROM calls UNION ALL SELECT callee, caller FROM calls) WHERE node IS NOT NULL AND other IS NOT NULL AND node <> other GROUP BY node"""
_COLO = """SELECT phone, place, count(*) FILTER (WHERE near > 0) AS n_calls, CAST(sum(near) AS BIGINT) AS n_near FROM (
  SELECT phone, place, count(*) OVER (PARTITION BY place ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING)
    - count(*) OVER (PARTITION BY place, phone ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING) AS near FROM parties WHERE place IS NOT NULL)
GROUP BY 1, 2 HAVING sum(near) > 0"""
_RAPID = """hop AS (SELECT DISTINCT src, dst, epoch_us(ts) AS t FROM transfers WHERE src IS NOT NULL AND dst IS NOT NULL),
walk(path, tail, lo, hi, n) AS (
  SELECT [src, dst], dst, t, t, 1 FROM hop
  UNION SELECT list_append(w.path, h.dst), h.dst, least(w.lo, h.t), greatest(w.hi, h.t), w.n + 1 FROM walk w JOIN hop h ON h.src = w.tail
  WHERE w.n < 5 AND (w.n = 1 OR w.hi - w.lo < 172800000000) AND greatest(w.hi, h.t) - least(w.lo, h.t) <= 172800000000)"""
_PATHS = """SELECT DISTINCT array_to_string(s, ',') AS accounts, CAST(len(s) AS BIGINT) AS n_accounts FROM (SELECT list_sort(list_distinct(path)) AS s FROM walk WHERE n >= 2)"""
_FLAGS = f"""{_RAPID},
paths AS ({_PATHS}),
flags AS (
  SELECT phone AS key, 'COMMUNICATION_SPIKE' AS flag, peak || ' calls within 24 hours' AS evidence FROM ({_SPIKE})
  UNION ALL SELECT src, 'HIGH_TRANSACTION_FREQUENCY', peak || ' transfers within 24 hours' FROM ({_FREQ})
  UNION ALL SELECT src, 'HIGH_TRANSACTION_FREQUENCY', 'large transfer ' || txn_id FROM ({_LARGE})
  UNION ALL SELECT dst, 'MULTI_SUSPECT_SHARED_ACCOUNT', n_senders || ' senders' FROM ({_FAN})
  UNION ALL SELECT unnest(string_split(accounts, ',')), 'RAPID_FUND_MOVEMENT', 'fund path through ' || accounts FROM paths
  UNION ALL SELECT phone, 'INCIDENT_TIMING_CLUSTER', n_calls || ' calls around ' || incident FROM ({_CLUSTER})),
ranked AS (SELECT key, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags, count(*) AS n_flags, string_agg(flag || ': ' || evidence, '; ' ORDER BY flag || ': ' || evidence) AS evidence,
  round(0.5 * least(count(*) / 3, 1.0), 4) AS flag_score FROM flags GROUP BY key)"""
_ALL = ("calls", "parties", "transfers")

ORACLE = {
    "rolling_spike": with_tables(*_P) + _SPIKE,
    "freq_anomaly": with_tables(*_T) + _FREQ,
    "burst_score": with_tables(*_P) + _BURST,
    "large_single": with_tables(*_T) + _LARGE,
    "fan_in_shared": with_tables(*_T) + _FAN,
    "incident_cluster": with_tables(*_P, more=_INCIDENTS) + _CLUSTER,
    "off_hour_motif": with_tables(*_P) + """SELECT * FROM (SELECT phone, n_off, n_peak, round(CASE WHEN n_peak > 0 THEN (n_off / 6) / (n_peak / 18) ELSE n_off / 6 END, 4) AS ratio
      FROM (SELECT phone, count(*) FILTER (WHERE hour(ts) IN (23, 0, 1, 2, 3, 4)) AS n_off, count(*) FILTER (WHERE hour(ts) NOT IN (23, 0, 1, 2, 3, 4)) AS n_peak FROM parties GROUP BY phone)) WHERE ratio >= 1.5""",
    "late_ratio": with_tables(*_P) + _LATE,
    "call_profile": with_tables("calls") + _CALLS,
    "txn_profile": with_tables(*_T) + _TXN,
    "counterparty_degree": with_tables("calls") + _DEGREE,
    "colocation": with_tables(*_P) + _COLO,
    "flag_ranking": with_tables(*_ALL, more=_INCIDENTS + ",\n" + _FLAGS) + "SELECT * FROM ranked",
    "flagged_entities": with_tables(*_ALL, "vertices", more=_INCIDENTS + ",\n" + _FLAGS + """,
carriers AS (SELECT entity_id, type, CASE WHEN type = 'PHONE' THEN (CASE WHEN length(regexp_replace(regexp_replace(name, '[^0-9]', '', 'g'), '^(?:0*91|0+)([0-9]{10})$', '\\1')) = 10 THEN regexp_replace(regexp_replace(name, '[^0-9]', '', 'g'), '^(?:0*91|0+)([0-9]{10})$', '\\1') END)
    ELSE nullif(upper(regexp_replace(name, '[^0-9A-Za-z]', '', 'g')), '') END AS key FROM vertices WHERE type IN ('PHONE', 'ACCOUNT')
  UNION SELECT person_id, 'PERSON', phone FROM subscribers WHERE phone IS NOT NULL UNION SELECT person_id, 'PERSON', account FROM subscribers WHERE account IS NOT NULL)""")
    + "SELECT v.entity_id, v.type, r.key, r.flags, r.n_flags, r.flag_score FROM ranked r JOIN carriers v USING (key)",
    "risk_topn": with_tables(*_ALL, more=f"""people AS (SELECT * FROM subscribers WHERE person_id IS NOT NULL AND full_name IS NOT NULL),
      phones AS (SELECT DISTINCT person_id, full_name, phone AS key FROM people WHERE phone IS NOT NULL),
      night AS (SELECT phone AS key, count(*) AS n_calls, count(*) FILTER (WHERE hour(ts) < 6) AS n_late, min(call_id) AS first_call FROM parties GROUP BY 1),
      seats AS (SELECT c.place, c.ts, a.phone, c.call_id, count(*) OVER (PARTITION BY c.call_id) AS k, row_number() OVER (PARTITION BY c.call_id ORDER BY (a.phone = c.caller) DESC) AS i
        FROM calls c JOIN (SELECT DISTINCT phone FROM people WHERE phone IS NOT NULL) a ON a.phone = c.caller OR a.phone = c.callee WHERE c.place IS NOT NULL),
      near AS (SELECT phone AS key, least(sum(n) / 10, 1.0) AS colocation FROM (SELECT phone,
          sum(CASE WHEN i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY place ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING)
          - sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY place, phone ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 24 HOUR FOLLOWING) AS n FROM seats) GROUP BY 1),
      by_phone AS (SELECT person_id, full_name, max(least(0.6 * coalesce(night.n_late / night.n_calls, 0.0) + 0.4 * coalesce(burst, 0.0), 1.0)) AS temporal, max(coalesce(colocation, 0.0)) AS colocation, max(coalesce(call_score, 0.0)) AS call_score,
        sum(coalesce(night.n_calls, 0)) AS n_calls, sum(coalesce(night.n_late, 0)) AS n_late, min(first_call) AS first_call
        FROM phones LEFT JOIN night USING (key) LEFT JOIN ({_BURST}) b ON b.phone = key LEFT JOIN near USING (key) LEFT JOIN ({_CALLS}) c ON c.caller = key GROUP BY 1, 2),
      ends AS (SELECT caller AS x, callee AS y FROM calls UNION ALL SELECT src, dst FROM transfers),
      keys AS (SELECT DISTINCT person_id, phone AS key FROM people WHERE phone IS NOT NULL UNION SELECT person_id, account FROM people WHERE account IS NOT NULL),
      met AS (SELECT person_id, count(DISTINCT y) AS n_parties FROM keys JOIN (SELECT x, y FROM ends UNION ALL SELECT y, x FROM ends) w ON w.x = key WHERE y IS NOT NULL AND x <> y GROUP BY 1),
      by_account AS (SELECT person_id, max(txn_score) AS txn_score, sum(n_transfers) AS n_transfers, sum(n_large) AS n_large, sum(CAST(total AS DECIMAL(20,2))) AS total, min(first_txn) AS first_txn
        FROM (SELECT DISTINCT person_id, account AS key FROM people WHERE account IS NOT NULL) a JOIN ({_TXN}) t ON t.account = a.key
        LEFT JOIN (SELECT x, min(txn_id) AS first_txn FROM (SELECT src AS x, txn_id FROM transfers UNION ALL SELECT dst, txn_id FROM transfers) GROUP BY 1) f ON f.x = a.key GROUP BY 1),
      total AS (SELECT count(DISTINCT x) AS n_all FROM (SELECT x FROM ends UNION ALL SELECT y FROM ends)),
      scored AS (SELECT *, round(100 * (0.20 * least(coalesce(n_parties, 0) / greatest(n_all - 1, 1), 1.0) + 0.20 * temporal + 0.15 * colocation + 0.20 * call_score + 0.25 * coalesce(txn_score, 0.0)), 1) AS risk
        FROM by_phone LEFT JOIN by_account USING (person_id) LEFT JOIN met USING (person_id), total)""")
    + """SELECT person_id, full_name, risk, printf('1) %d calls, %d between midnight and six (see %s). 2) %d transfers of %.0f in all, %d above 100000 (see %s). 3) co-location %.2f, calls %.2f',
      CAST(n_calls AS BIGINT), CAST(n_late AS BIGINT), coalesce(first_call, 'none'), CAST(coalesce(n_transfers, 0) AS BIGINT), CAST(coalesce(total, 0) AS DOUBLE), CAST(coalesce(n_large, 0) AS BIGINT), coalesce(first_txn, 'none'), CAST(colocation AS DOUBLE), CAST(call_score AS DOUBLE)) AS reason
      FROM scored ORDER BY risk DESC, person_id LIMIT 20""",
    "light_risk": with_tables("calls", "transfers", more="""people AS (SELECT * FROM subscribers WHERE person_id IS NOT NULL AND full_name IS NOT NULL),
      seat AS (SELECT caller AS phone, callee AS other, call_id, hour(ts) IN (23, 0, 1, 2, 3, 4) AS late FROM calls UNION ALL SELECT callee, caller, call_id, hour(ts) IN (23, 0, 1, 2, 3, 4) FROM calls),
      called AS (SELECT person_id, count(DISTINCT other) AS n_contacts, count(DISTINCT call_id) AS n_calls, count(DISTINCT CASE WHEN late THEN call_id END) AS n_late FROM seat JOIN (SELECT DISTINCT person_id, phone FROM people WHERE phone IS NOT NULL) USING (phone) GROUP BY 1),
      moved AS (SELECT person_id, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total FROM (SELECT src AS account, amount FROM transfers UNION ALL SELECT dst, amount FROM transfers) JOIN (SELECT DISTINCT person_id, account FROM people WHERE account IS NOT NULL) USING (account) GROUP BY 1)""")
    + """SELECT person_id, full_name, round(100 * (0.30 * least(coalesce(n_contacts, 0) / (SELECT count(DISTINCT person_id) FROM people), 1.0) + 0.25 * coalesce(n_late, 0) / greatest(coalesce(n_calls, 0), 1) + 0.45 * least(greatest(coalesce(total, 0.0), 0.0) / 5000000, 1.0)), 2) AS risk
      FROM (SELECT person_id, min(full_name) AS full_name FROM people GROUP BY 1) LEFT JOIN called USING (person_id) LEFT JOIN moved USING (person_id) ORDER BY risk DESC, person_id LIMIT 3""",
}
