"""Predicates and scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.config import BaseErrorConfig, StructuralErrorConfig

BE, SE = BaseErrorConfig(), StructuralErrorConfig()


def terminal_region(start0: Column, end0: Column, length: Column, size: int = BE.terminal) -> Column:
    """Whether a region touches the first or last `size` bases, borders included; false for an unknown contig."""
    return length.isNotNull() & ((start0 <= size) | (end0 >= length - size))


def terminal_window(start0: Column, length: Column, size: int = SE.terminal) -> Column:
    """Whether a window begins within the first or last `size` bases; an unknown contig has length 0."""
    return (start0 < size) | (start0 >= F.coalesce(length, F.lit(0)) - size)


def low_complexity(ag: Column, ct: Column, gc: Column, cfg: BaseErrorConfig = BE) -> Column:
    return (((ag >= cfg.mono_ratio) | (ct >= cfg.mono_ratio)) & (gc >= cfg.mono_gc_ratio)) | (gc >= cfg.gc_ratio)


def relative_support(hifi: Column, hifi_depth: Column, ont: Column, ont_depth: Column, cfg: BaseErrorConfig = BE) -> Column:
    """Whether either platform's perfect reads make the least share of its depth."""

    def enough(n: Column, depth: Column) -> Column:
        return F.coalesce((n > 0) & (F.try_divide(n.cast("double"), depth) >= cfg.relative_support), F.lit(False))

    return enough(hifi, hifi_depth) | enough(ont, ont_depth)


def absolute_support(hifi: Column, ont: Column, cfg: BaseErrorConfig = BE) -> Column:
    return (hifi > cfg.hifi_support) | (ont > cfg.ont_support)


def supported(rows: dict[str, Column], terminal: Column, cfg: BaseErrorConfig = BE) -> Column:
    """By share of depth at contig ends and in low-complexity windows, by number of reads elsewhere."""
    share = relative_support(rows["hifi"], rows["hifi_depth"], rows["ont"], rows["ont_depth"], cfg)
    plain = low_complexity(rows["ag"], rows["ct"], rows["gc"], cfg)
    return F.when(terminal | plain, share).otherwise(absolute_support(rows["hifi"], rows["ont"], cfg))


def depth_tag(depth: Column, mean: Column, cfg: StructuralErrorConfig = SE) -> Column:
    """low_depth or high_depth against the mean; a window without depth has no tag."""
    return F.when((depth > 0) & (depth < mean * cfg.low_depth), F.lit("low_depth")).when(depth > mean * cfg.high_depth, F.lit("high_depth"))


def above_ratio(n: Column, total: Column, least: float = SE.event_ratio) -> Column:
    return F.coalesce((total > 0) & (F.try_divide(n.cast("double"), total.cast("double")) > least), F.lit(False))


def terminal_tag(clean: Column, total: Column, indels: Column, cfg: StructuralErrorConfig = SE) -> Column:
    """indel or clip if hardly a read of a terminal window is clean."""
    bad = (total > 0) & ((clean < 1) | (F.try_divide(clean.cast("double"), total.cast("double")) <= cfg.clean_ratio))
    return F.when(bad, F.when(indels > 0, F.lit("indel")).otherwise(F.lit("clip")))


def anomaly_tags(w: dict[str, Column], mean: Column, cfg: StructuralErrorConfig = SE) -> Column:
    """array<string>: tags of a window in their order; an insertion and a deletion tag both read indel."""
    inner = [
        depth_tag(w["depth"], mean, cfg),
        F.when(above_ratio(w["clips"], w["reads"], cfg.event_ratio), F.lit("clip")),
        F.when(above_ratio(w["reads_with_insertion"], w["reads"], cfg.event_ratio), F.lit("indel")),
        F.when(above_ratio(w["reads_with_deletion"], w["reads"], cfg.event_ratio), F.lit("indel")),
    ]
    ends = [terminal_tag(w["clean"], w["reads"], w["insertions"] + w["deletions"], cfg)]
    tags = F.when(w["terminal"], F.array(*ends)).otherwise(F.array(*inner))
    return F.array_compact(F.concat(F.array(F.when(~w["spanning"], F.lit("non_spanning"))), tags))


def error_type(reasons: Column) -> Column:
    """One type for a free-text list of reasons, the first that fits."""
    has = lambda s: reasons.contains(s)
    return (
        F.when(has("Low depth"), "low_depth")
        .when(has("High depth"), "high_depth")
        .when(has("insertion reads ratio") | has("deletion reads ratio"), "indel")
        .when(has("clip ratio"), "clip")
        .when(has("Terminal region anomaly"), "terminal")
        .otherwise("other")
    )


def phred(errors: Column, length: Column) -> Column:
    """-10 * log10(errors / length); infinity without an error, null without a length."""
    ratio = errors.cast("double") / length.cast("double")
    return F.when(length <= 0, F.lit(None).cast("double")).when(errors <= 0, F.lit(float("inf"))).otherwise(F.lit(-10.0) * F.log10(ratio))


def phred_text(errors: Column, length: Column) -> Column:
    """The score with two decimals, ∞ without an error, N/A if errors have no length to stand in."""
    score = phred(errors, length)
    return F.when(errors <= 0, F.lit("∞")).when(score.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", score))
