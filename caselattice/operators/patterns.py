"""Detectors over calls and transfers. Each gives ``(key, flag, evidence)`` or a profile per key.

Thresholds come from the frozen rules. Flags carry the figures they rest on as evidence; they express review priority only.
All aggregates combine before the shuffle, and time windows are blocked (see ``rolling``), so no key's rows meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RULES, Rules
from .rolling import BLOCK, first_over, micros, peak_counts


def communication_spikes(parties: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Phones whose calls within some rolling day reach the threshold: ``phone, peak``."""
    peaks = peak_counts(parties, "phone", "ts", rules.spike_hours * 3600, "call_id")
    return peaks.filter(F.col("peak") >= rules.spike_calls).select("phone", "peak")


def frequency_anomalies(transfers: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Accounts whose busiest rolling day stands out from their mean: ``src, peak, mean_count``.

    Windows start at each transfer; those that tie in time count from their place in the order.
    """
    peaks = peak_counts(transfers, "src", "ts", rules.spike_hours * 3600, "txn_id", ties="index")
    return peaks.filter(
        (F.col("peak") >= rules.frequency_least) & (F.col("peak") >= rules.frequency_factor * F.col("mean_count"))
    ).select("src", "peak", F.round("mean_count", 6).alias("mean_count"))


def burst_scores(parties: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Per phone the busiest two hours against the burst threshold, at most 1."""
    peaks = peak_counts(parties, "phone", "ts", rules.burst_seconds, "call_id")
    return peaks.select("phone", "peak", F.round(F.least(F.col("peak") / rules.burst_calls, F.lit(1.0)), 4).alias("burst"))


def large_singles(transfers: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Per account the first transfer that reaches the large amount."""
    return first_over(transfers, "src", "ts", "amount", rules.large_amount, "txn_id")


def fan_in(transfers: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Accounts fed by several different senders: ``dst, n_senders, n_transfers``; self-transfers do not count."""
    real = transfers.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
    pairs = real.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n"))  # a hot receiver is combined per sender first
    return pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n_senders"), F.sum("n").alias("n_transfers")).filter(F.col("n_senders") >= rules.fan_in_senders)


def incident_clusters(parties: DataFrame, incidents: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Phones with several calls within days of an incident: ``phone, incident, n_calls``.

    ``incidents`` has one ``incident`` date per row. Each is entered for every day of its window, so the join is on the day.
    """
    days = incidents.select("incident", F.explode(F.sequence(F.date_sub("incident", rules.incident_days), F.date_add("incident", rules.incident_days))).alias("day"))
    # the last day counts up to midnight only
    per_day = parties.groupBy("phone", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") == F.to_date("ts").cast("timestamp_ntz")).alias("at_midnight")
    )
    last = F.col("day") == F.date_add("incident", rules.incident_days)
    counted = per_day.join(days, "day").withColumn("n", F.when(last, F.col("at_midnight")).otherwise(F.col("n")))
    return counted.groupBy("phone", "incident").agg(F.sum("n").alias("n_calls")).filter(F.col("n_calls") >= rules.incident_events)


def off_hour_motifs(parties: DataFrame, rules: Rules = RULES) -> DataFrame:
    """Phones whose hourly rate in the off hours exceeds that of the others: counts, rates and their ratio."""
    off = F.hour("ts").isin(*rules.off_hours)
    n_off = len(rules.off_hours)
    counted = parties.groupBy("phone").agg(F.count_if(off).alias("n_off"), F.count_if(~off).alias("n_peak"))
    rate_off, rate_peak = F.col("n_off") / n_off, F.col("n_peak") / (24 - n_off)
    ratio = F.when(F.col("n_peak") > 0, rate_off / rate_peak).otherwise(rate_off)
    return counted.withColumn("ratio", F.round(ratio, 4)).filter(F.col("ratio") >= rules.motif_ratio)


def late_ratios(parties: DataFrame) -> DataFrame:
    """Per phone the share of calls between midnight and six."""
    return parties.groupBy("phone").agg(F.round(F.avg((F.hour("ts") < 6).cast("int")), 6).alias("late_ratio"), F.count(F.lit(1)).alias("n_calls"))


def call_profiles(calls: DataFrame) -> DataFrame:
    """Outgoing behaviour per caller: volume, most repeated callee, share of short calls and their weighted score."""
    per_pair = calls.filter("caller IS NOT NULL").groupBy("caller", "callee").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_s") < 30).alias("n_short")
    )
    per = per_pair.groupBy("caller").agg(F.sum("n").alias("n_calls"), F.max(F.when(F.col("callee").isNotNull(), F.col("n"))).alias("most_repeated"), F.sum("n_short").alias("n_short"))
    capped = lambda c: F.least(c, F.lit(1.0))
    score = 0.4 * capped(F.col("n_calls") / 30) + 0.4 * capped(F.coalesce("most_repeated", F.lit(0)) / 5) + 0.2 * F.col("n_short") / F.col("n_calls")
    return per.withColumn("call_score", F.round(score, 4))


def transfer_profiles(transfers: DataFrame) -> DataFrame:
    """Per account, as sender or receiver: number, large ones, total, counterparties and their weighted score."""
    ends = transfers.select("src", "dst", "amount").filter("src IS NOT NULL OR dst IS NOT NULL")
    sides = ends.select(F.col("src").alias("account"), F.col("dst").alias("other"), "amount").unionByName(
        ends.filter("NOT (src <=> dst)").select(F.col("dst").alias("account"), F.col("src").alias("other"), "amount")
    ).filter("account IS NOT NULL")
    pairs = sides.groupBy("account", "other").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("amount") > 100_000).alias("n_large"), F.sum(F.col("amount").cast("decimal(18,2)")).alias("total")
    )
    per = pairs.groupBy("account").agg(
        F.sum("n").alias("n_transfers"), F.sum("n_large").alias("n_large"), F.sum("total").cast("double").alias("total"), F.count("other").alias("n_parties")
    )
    capped = lambda c: F.least(c, F.lit(1.0))
    score = (
        0.25 * capped(F.col("n_transfers") / 15) + 0.30 * capped(F.col("n_large") / 3)
        + 0.25 * capped(F.greatest(F.coalesce("total", F.lit(0.0)), F.lit(0.0)) / 500_000) + 0.20 * capped(F.col("n_parties") / 8)
    )
    return per.withColumn("txn_score", F.round(score, 4))


def counterparty_degrees(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct counterparties of each id over the number of other ids: ``node, n_parties, degree``."""
    both = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(pairs.select(F.col(b).alias("node"), F.col(a).alias("other")))
    distinct = both.filter("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct()
    degrees = distinct.groupBy("node").agg(F.count(F.lit(1)).alias("n_parties"))
    total = both.filter("node IS NOT NULL").agg(F.countDistinct("node").alias("n_all"))  # one row
    return degrees.crossJoin(F.broadcast(total)).select("node", "n_parties", F.round(F.col("n_parties") / F.greatest(F.col("n_all") - 1, F.lit(1)), 6).alias("degree"))


def near_counts(rows: DataFrame, place: str, phone: str, ts: str, hours: int, all_weight: str, own_weight: str) -> DataFrame:
    """Rows with ``near``: the sum of ``all_weight`` over the place's rows within ``hours`` before or after, less that of
    ``own_weight`` over the phone's own among them.

    One shuffle by (place, time block) serves both windows; a row is also entered in the blocks its frame reaches.
    """
    frame = hours * 3_600_000_000
    width = frame * BLOCK
    of = lambda c: F.floor(c / F.lit(width)).cast("long")
    timed = rows.filter(F.col(place).isNotNull() & F.col(ts).isNotNull()).withColumn("_t", micros(F.col(ts)))
    blocked = timed.withColumn("_own", of(F.col("_t"))).withColumn("_block", F.explode(F.sequence(of(F.col("_t") - frame), of(F.col("_t") + frame)))).repartition(place, "_block")
    all_ = W.partitionBy(place, "_block").orderBy("_t").rangeBetween(-frame, frame)
    own = W.partitionBy(place, "_block", phone).orderBy("_t").rangeBetween(-frame, frame)
    near = F.sum(all_weight).over(all_) - F.sum(own_weight).over(own)
    return blocked.withColumn("near", near).filter("_own = _block").drop("_t", "_own", "_block")


def colocations(parties: DataFrame, hours: int = RULES.colocation_hours) -> DataFrame:
    """Per phone and place: its calls that others' calls at the place fall near to in time, and how many those are.

    Counts only, so no pairs are made: a frame over the place's calls gives all, one over the phone's own calls is taken off.
    """
    near = near_counts(parties.select("phone", "place", "ts", F.lit(1).cast("long").alias("one")), "place", "phone", "ts", hours, "one", "one")
    return near.groupBy("phone", "place").agg(F.count_if(F.col("near") > 0).alias("n_calls"), F.sum("near").alias("n_near")).filter("n_near > 0")


def known_colocations(calls: DataFrame, known: DataFrame, hours: int = RULES.colocation_hours) -> DataFrame:
    """``phone, n_near, colocation``: how often a known phone's calls meet calls of other known phones at one place.

    A call counts when any other known phone takes part, the phone's own calls to known phones included; ten or more are full score.
    ``known`` has one row per ``phone``.
    """
    of = lambda side: known.select(F.col("phone").alias(side), F.lit(True).alias(f"{side}_known"))
    marked = calls.select("caller", "callee", "ts", "place").join(of("caller"), "caller", "left").join(of("callee"), "callee", "left")
    who = F.array_distinct(F.array_compact(F.array(F.when(F.col("caller_known"), F.col("caller")), F.when(F.col("callee_known"), F.col("callee")))))
    seats = marked.withColumn("who", who).filter(F.size("who") > 0).select("ts", "place", "who", F.posexplode("who").alias("pos", "phone")).select(
        "phone", "place", "ts", (F.col("pos") == 0).cast("long").alias("one"), (F.size("who") == 1).cast("long").alias("alone")
    )
    near = near_counts(seats, "place", "phone", "ts", hours, "one", "alone")
    return near.groupBy("phone").agg(F.sum("near").alias("n_near")).withColumn("colocation", F.least(F.col("n_near") / 10, F.lit(1.0)))


def flags(*parts: tuple[DataFrame, str, str, object]) -> DataFrame:
    """Union of detectors as ``key, flag, evidence``: each part is (rows, key column, flag, evidence column)."""
    found = None
    for rows, key, flag, evidence in parts:
        one = rows.select(F.col(key).alias("key"), F.lit(flag).alias("flag"), evidence.alias("evidence"))
        found = one if found is None else found.unionByName(one)
    return found


def flag_totals(found: DataFrame, counted: DataFrame) -> DataFrame:
    """``flag_ranking`` without the evidence: per key its flags, how many there are and their part of the priority.

    ``counted`` has ``key, flag, n`` of flags that are known by number only.
    """
    each = found.groupBy("key", "flag").agg(F.count(F.lit(1)).alias("n")).unionByName(counted.select("key", "flag", "n"))
    return each.groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.sum("n").alias("n_flags")).withColumn("flag_score", _flag_score())


def _flag_score():
    return F.round(RULES.weight_flags * F.least(F.col("n_flags") / RULES.flags_for_full, F.lit(1.0)), 4)


def flag_ranking(found: DataFrame) -> DataFrame:
    """Per key its flags in order, how many there are, the evidence and the flags' part of the priority."""
    return (
        found.groupBy("key").agg(
            F.array_join(F.array_sort(F.collect_set("flag")), ",").alias("flags"), F.count(F.lit(1)).alias("n_flags"),
            F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "flag", "evidence"))), "; ").alias("evidence"),
        )
        .withColumn("flag_score", _flag_score())
    )
