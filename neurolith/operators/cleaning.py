"""Cleaning of EEG recordings as table work: line noise, epochs about events, conditions, references and thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remove_line(samples: DataFrame, keys: list[str], *, fs: float, freqs: list[float], seconds: float = 4.0, rounds: int = 1) -> DataFrame:
    """Add cleaned: value without the sine and cosine of each frequency that fit it best in each window of `seconds`.

    The fit of a window is five sums over it; frequencies are taken out one after the other, `rounds` times over, which comes
    to their joint fit. Windows do not overlap, so a recording is spread over as many groups as it has windows; the last one
    may be shorter.
    """
    size = max(2, int(round(seconds * fs)))
    d = samples.withColumn("_w", F.floor(F.col("sample_idx") / size)).withColumn("cleaned", F.col("value"))
    w = Window.partitionBy(*keys, "_w")
    for f in [*freqs] * rounds:
        angle = F.lit(2 * math.pi * f / fs) * F.col("sample_idx")
        d = d.withColumn("_c", F.cos(angle)).withColumn("_s", F.sin(angle))
        known = F.col("cleaned").isNotNull()
        total = lambda a, b: F.sum(F.when(known, F.col(a) * F.col(b))).over(w)
        d = d.withColumns({"_cc": total("_c", "_c"), "_ss": total("_s", "_s"), "_cs": total("_c", "_s"), "_xc": total("cleaned", "_c"), "_xs": total("cleaned", "_s")})
        det = F.col("_cc") * F.col("_ss") - F.col("_cs") * F.col("_cs")
        fit = ((F.col("_xc") * F.col("_ss") - F.col("_xs") * F.col("_cs")) * F.col("_c") + (F.col("_xs") * F.col("_cc") - F.col("_xc") * F.col("_cs")) * F.col("_s")) / det
        d = d.withColumn("cleaned", F.when(det > 1e-9, F.col("cleaned") - fit).otherwise(F.col("cleaned"))).drop("_c", "_s", "_cc", "_ss", "_cs", "_xc", "_xs")
    return d.drop("_w")


def event_epochs(samples: DataFrame, events: DataFrame, keys: list[str], *, before: int, after: int, offset: int = 0) -> DataFrame:
    """(keys, tag, onset, epoch): the values from onset - before to onset + after, both included, about each event.

    events: keys[0] (the recording), onset, tag; offset shifts every onset. Epochs that the recording does not hold whole are
    left out. Events meet samples by blocks as long as an epoch, one or two each, so a recording is spread over as many keys as
    it has blocks, and a sample meets only the events that are near it.
    """
    size = max(1, before + after + 1)
    block = lambda at: F.floor(at / size)
    e = events.select(F.col(keys[0]).alias("_k"), (F.col("onset") + offset).alias("onset"), "tag")
    e = e.withColumn("_b", F.explode(F.sequence(block(F.col("onset") - before), block(F.col("onset") + after))))
    near = (F.col("sample_idx") >= F.col("onset") - before) & (F.col("sample_idx") <= F.col("onset") + after)
    d = samples.filter(F.col("value").isNotNull()).withColumn("_a", block(F.col("sample_idx")))
    j = d.join(e, (F.col(keys[0]) == F.col("_k")) & (F.col("_a") == F.col("_b")) & near)
    g = j.groupBy(*keys, "tag", "onset").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_e"))
    return g.filter(F.size("_e") == before + after + 1).select(*keys, "tag", "onset", F.col("_e.value").alias("epoch"))


def untagged(recordings: DataFrame, events: DataFrame, key: str, tags: list[str] | None = None) -> DataFrame:
    """Recordings without any event (of tags): key, error_type NoTags and a message, rows for the table of errors."""
    some = events.filter(F.col("tag").isin(*tags)) if tags else events
    gone = recordings.select(key).distinct().join(some.select(key).distinct(), key, "left_anti")
    return gone.select(key, F.lit("NoTags").alias("error_type"), F.lit("no event of the wanted kinds").alias("message"))


def by_condition(epochs: DataFrame, conditions: dict[str, list[str]]) -> DataFrame:
    """Epochs with the conditions (name: its tags) that their tag belongs to, a row for each; others are left out."""
    names = F.array_compact(F.array(*[F.when(F.col("tag").isin(*tags), F.lit(name)) for name, tags in conditions.items()]))
    return epochs.withColumn("condition", F.explode(names))


def with_reference(samples: DataFrame, keys: list[str], channel: str, name: str) -> DataFrame:
    """samples and a channel `name` of zeros, at every place that any channel has: the reference put back."""
    places = samples.select(*[k for k in keys if k != channel], "sample_idx").distinct()
    return samples.select(*keys, "sample_idx", "value").unionByName(places.withColumn(channel, F.lit(name)).withColumn("value", F.lit(0.0)))


def kept_channels(samples: DataFrame, channel: str, *, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Samples of the channels in include (all without it) that are not in exclude."""
    d = samples.filter(F.col(channel).isin(*include)) if include is not None else samples
    return d.filter(~F.col(channel).isin(*exclude)) if exclude else d


def bayes_threshold(details: DataFrame, keys: list[str], value: str, *, soft: bool = True) -> DataFrame:
    """Add threshold and shrunk to detail coefficients of one level: BayesShrink within keys.

    The noise is median(|d|) / 0.6745; the threshold its square over the root of the signal's variance, mean(d^2) less the
    noise's, at least 1e-12.
    """
    noise = F.median(F.abs(F.col(value))) / 0.6745
    at = details.groupBy(*keys).agg((noise * noise / F.sqrt(F.greatest(F.avg(F.col(value) * F.col(value)) - noise * noise, F.lit(1e-12)))).alias("threshold"))
    x, t = F.col(value), F.col("threshold")
    shrunk = F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)) if soft else F.when(F.abs(x) >= t, x).otherwise(F.lit(0.0))
    return details.join(at, keys).withColumn("shrunk", shrunk)


def block_of(place: Column, n: Column, block: int) -> Column:
    """The block of a place when n values are split into round(n / block) parts (one at least) as evenly as can be, longer ones first."""
    parts = F.greatest(F.lit(1), F.bround(n / block)).cast("long")
    size, longer = F.floor(n / parts), n % parts
    return F.when(place < longer * (size + 1), F.floor(place / (size + 1))).otherwise(longer + F.floor((place - longer * (size + 1)) / F.greatest(size, F.lit(1))))


def wavelet_choice(erp: bool, fs: float) -> tuple[str, int]:
    """The wavelet and level for evoked responses and for the rest, above 500 Hz, above 250 Hz, and below."""
    at = 0 if fs > 500 else 1 if fs > 250 else 2
    return ("coif4", (11, 10, 9)[at]) if erp else ("bior4.4", (10, 9, 8)[at])


def quality_row(recordings: DataFrame, channels: DataFrame, epochs: DataFrame, key: str) -> DataFrame:
    """One row for each recording: n_channels, n_good, percent_good of channels (key, channel, bad), and n_epochs, n_kept,
    percent_kept of epochs (key, epoch, rejected); zero counts where there are none."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b))
    c = channels.groupBy(key).agg(F.count(F.lit(1)).alias("n_channels"), F.count_if(~F.col("bad")).alias("n_good"))
    e = epochs.groupBy(key).agg(F.count(F.lit(1)).alias("n_epochs"), F.count_if(~F.col("rejected")).alias("n_kept"))
    d = recordings.select(key).distinct().join(c, key, "left").join(e, key, "left").fillna(0, ["n_channels", "n_good", "n_epochs", "n_kept"])
    return d.withColumn("percent_good", share("n_good", "n_channels")).withColumn("percent_kept", share("n_kept", "n_epochs"))


def local_threshold(details: DataFrame, keys: list[str], value: str, place: str, *, n: Column, block: Column, hop: Column, soft: bool = True) -> DataFrame:
    """Add threshold and shrunk to detail coefficients (places 0 to n - 1 in keys), by thresholds that change without steps.

    About a centre at every `hop`-th place, and at the last, lie block // 2 coefficients before and as many from it on, as far
    as there are any; these windows overlap, and each has its BayesShrink threshold (0 where the noise is). Between two
    centres the threshold runs in a line. Soft thresholds shrink; hard ones keep what exceeds them. n, block and hop are
    columns, alike within keys; block is at least 2.
    """
    d = details.withColumns({"_n": n.cast("long"), "_half": F.floor(block / 2).cast("long"), "_hop": hop.cast("long")})
    k, last = F.col(place), F.floor((F.col("_n") - 1) / F.col("_hop"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((k - F.col("_half") + 1) / F.col("_hop")))
    regular = F.sequence(first, F.least(last, F.floor((k + F.col("_half")) / F.col("_hop"))))
    regular = F.when(F.least(last, F.floor((k + F.col("_half")) / F.col("_hop"))) >= first, regular).otherwise(F.array().cast("array<bigint>"))
    at_end = ((F.col("_n") - 1) % F.col("_hop") > 0) & (k >= F.col("_n") - 1 - F.col("_half"))
    spread = d.withColumn("_c", F.explode(F.when(at_end, F.concat(regular, F.array(last + 1))).otherwise(regular)))
    noise, x = F.median(F.abs(F.col(value))) / 0.6745, F.col(value)
    at = spread.groupBy(*keys, "_n", "_hop", "_c").agg((noise * noise / F.sqrt(F.greatest(F.avg(x * x) - noise * noise, F.lit(1e-12)))).alias("_t"))
    w = Window.partitionBy(*keys).orderBy("_c")
    at = at.withColumn("_p", F.least(F.col("_c") * F.col("_hop"), F.col("_n") - 1))
    at = at.withColumns({"_t2": F.coalesce(F.lead("_t").over(w), F.col("_t")), "_p2": F.coalesce(F.lead("_p").over(w), F.col("_p") + 1)}).select(*keys, "_c", "_t", "_p", "_t2", "_p2")
    d = d.withColumn("_c", F.floor(k / F.col("_hop"))).join(at, [*keys, "_c"])
    d = d.withColumn("threshold", F.col("_t") + (F.col("_t2") - F.col("_t")) * (k - F.col("_p")) / (F.col("_p2") - F.col("_p")))
    t = F.col("threshold")
    shrunk = F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0)) if soft else F.when(F.abs(x) > t, x).otherwise(F.lit(0.0))
    return d.withColumn("shrunk", shrunk).drop("_n", "_half", "_hop", "_c", "_t", "_p", "_t2", "_p2")
