"""Scales stated in different units and conventions, brought to counts per millivolt.

A scale may be counts per unit, units per count, or a range that a number of counts stands for. Where no unit is stated,
a convention says which is meant. Where there is no convention either, the gains' logarithms tell: all channels share one
set of usual gains, so a missing unit shifts a channel's logarithm by a known conversion factor. A mixture whose components
differ only by these shifts is fitted to a histogram of all gains; its posterior assigns the unit and its uncertainty is
reported.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadframe.functions.expr import let

# Units of voltage and how many of them make one millivolt.
PER_MV = {"V": 1e-3, "mV": 1.0, "uV": 1e3, "nV": 1e6}
# How units are written, in lower case with micro signs as u, accents and plural s off.
_SPELLED = {"V": ("v", "volt"), "mV": ("mv", "millivolt", "milli volt"), "uV": ("uv", "microvolt", "micro volt"), "nV": ("nv", "nanovolt", "nano volt")}
# Spellings of a unit that name none.
_NAMELESS = ("", "-", "--", "adu", "counts", "count", "n/a", "none", "null", "?", "unknown")
# Words by which a text speaks of the values themselves, and of anything else.
_OF_VALUES = r"\b(?:units?|einheit(?:en)?|unites?|unidad(?:es)?|amplitudes?|values?|werte|traces?|signals?|samples?|exported|export|scale|data)\b"
_OF_OTHERS = r"\b(?:noise|floor|calibration|pulse|battery|notch|pass|filter|threshold|trigger|offset|supply|range|limit|gain|hz)\b"

_UNIT = r"(?:(?:milli|micro|nano) ?)?volts?|[mun]?v"


def _plain(text: Column) -> Column:
    """Lower case, micro signs as u, accents off, blanks single."""
    t = F.lower(F.translate(text, "µμéèÉÈ", "uueeee"))
    return F.trim(F.regexp_replace(t, r"[\s ]+", " "))


def _unit(text: Column) -> Column:
    """The unit that a plain text is, else null."""
    t = F.regexp_replace(text, r"volts$", "volt")
    out = F.lit(None).cast("string")
    for unit, names in _SPELLED.items():
        out = F.when(t.isin(*names), unit).otherwise(out)
    return out


def stated_scale(units: Column, info: Column) -> Column:
    """Struct of ``unit`` (V, mV, uV, nV; null: not stated), ``inverse`` (units per count), ``other`` (another quantity).

    A unit that ``units`` names comes first. Where it names nothing, ``info`` counts if it speaks of the values and of
    nothing else. A name that is no unit of voltage is another quantity.
    """
    per_count = r" ?(?:/|per) ?(?:bit|count|lsb|adu|step)s?$"

    def said(i: Column) -> Column:
        named = F.regexp_extract(i, rf"(?:^|[^a-z0-9])({_UNIT})(?:[^a-z0-9]|$)", 1)
        return F.when(i.rlike(_OF_VALUES) & ~i.rlike(_OF_OTHERS), _unit(named))

    def named(u: Column) -> Column:
        nameless = u.isin(*_NAMELESS)
        unit = F.when(nameless, let(F.coalesce(_plain(info), F.lit("")), said)).otherwise(let(F.regexp_replace(u, per_count, ""), _unit))
        return let(unit, lambda x: F.struct(x.alias("unit"), (u.rlike(per_count) & ~nameless).alias("inverse"), (~nameless & x.isNull()).alias("other")))

    return let(F.coalesce(_plain(units), F.lit("")), named)


def range_mv(text: Column) -> Column:
    """Millivolts that a printed input range stands for (5 mV, +/- 5 mV, 5000uV, 0.005 V); null if it is none."""
    pattern = rf"^(?:\+/-|\+-|±)? ?([0-9]+(?:\.[0-9]+)?) ?({_UNIT})$"
    per = F.create_map(*[F.lit(x) for k, v in PER_MV.items() for x in (k, v)])

    def read(t: Column) -> Column:
        number = F.regexp_extract(t, pattern, 1).try_cast("double")
        return F.when(number > 0, let(_unit(F.regexp_extract(t, pattern, 2)), lambda u: F.when(u.isNotNull(), number / per[u])))

    return let(_plain(text), read)


def fit_shifted_mixture(
    known: np.ndarray, known_n: np.ndarray, open_: np.ndarray, open_n: np.ndarray, shifts: np.ndarray, prior: np.ndarray, width: float = 0.05, rounds: int = 50
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the units among the open values, by EM over histograms of log10.

    The shape of one component is the smoothed histogram of the ``known`` values (log10 counts per mV); component k is that
    shape moved by ``shifts[k]``. ``prior`` are pseudo-counts. Returns bins of the open values, their posteriors, weights.
    """
    centres, n = (known, known_n) if len(known) else (open_, open_n)
    share = n / n.sum()

    def density(x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - centres[None, :]) / width
        return np.exp(-0.5 * z * z) @ share / (width * math.sqrt(2 * math.pi)) + 1e-6

    like = np.stack([density(open_ - s) for s in shifts], axis=1)
    weights = prior / prior.sum()
    for _ in range(rounds):
        post = like * weights
        post /= post.sum(axis=1, keepdims=True)
        new = (post * open_n[:, None]).sum(axis=0) + prior
        new /= new.sum()
        if np.abs(new - weights).max() < 1e-9:
            weights = new
            break
        weights = new
    post = like * weights
    return open_, post / post.sum(axis=1, keepdims=True), weights


def _fitted(df: DataFrame, bins_per_decade: int) -> DataFrame:
    """``df`` with ``_fit``: unit and posterior of every open row by the mixture; reads the table once for its histogram."""
    per = F.create_map(*[F.lit(x) for k, v in PER_MV.items() for x in (k, v)])
    df = df.withColumn("_bin", F.round(F.log10("_g") * bins_per_decade).cast("int"))
    # Known rows are binned in counts per mV, open ones as they are.
    hist = (
        df.filter(F.col("_g").isNotNull())
        .groupBy(F.col("_s.unit").isNull().alias("open"), F.round(F.log10(F.col("_g") / F.coalesce(1 / per[F.col("_s.unit")], F.lit(1.0))) * bins_per_decade).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = hist.collect()
    names = list(PER_MV)
    pick = [(r["bin"] / bins_per_decade, r["n"]) for r in rows if not r["open"]]
    left = [(r["bin"], r["n"]) for r in rows if r["open"]]
    table: dict[int, tuple[str, float]] = {}
    if left:
        b, n = np.array(left, float).T
        k, kn = np.array(pick, float).T if pick else (np.zeros(0), np.zeros(0))
        # Proportions of the open rows, so that the number of rows does not matter.
        prior = n.sum() * np.full(len(names), 1e-3)
        shifts = np.array([-math.log10(PER_MV[u]) for u in names])
        _, post, _ = fit_shifted_mixture(k, kn, b / bins_per_decade, n, shifts, prior)
        best = post.argmax(axis=1)
        table = {int(x): (names[i], float(p[i])) for x, i, p in zip(b, best, post, strict=True)}
    fitted = df.sparkSession.createDataFrame([(b, (u, p)) for b, (u, p) in table.items()], "_bin int, _found struct<unit:string,p:double>")
    return df.join(F.broadcast(fitted), "_bin", "left").withColumn("_fit", F.when(F.col("_open"), F.col("_found"))).drop("_bin", "_found")


def counts_per_mv(
    channels: DataFrame,
    gain: str = "adc_gain",
    units: str = "adc_units",
    info: str = "info_text",
    saturation: str = "adc_saturation",
    span: str = "range_text",
    default: str | None = "mV",
    sure: float = 0.9,
    bins_per_decade: int = 100,
) -> DataFrame:
    """``channels`` with ``scale_mv`` (counts per mV), ``unit``, ``inverse``, ``basis``, ``posterior``, ``uncertain``.

    ``basis`` says where the scale comes from: range, stated (in the units or the info text), fitted, or null. With a
    usable range and saturation the range decides. Otherwise a usable gain (finite, above 0) is read in its stated unit.
    Where none is stated (basis fitted) it is ``default``, the unit that a convention says is meant: then nothing is fitted
    and no row uncertain. Without a convention (``default`` None) the mixture decides, in which all units have the same few
    pseudo-counts; a row whose best unit has a posterior under ``sure`` is ``uncertain``.
    Channels of another quantity, or with neither, keep a null scale. Nulls, nan, zero and negative numbers are unusable.

    The fit reads a histogram of log10 gains (``bins_per_decade``; under 62,000 bins over all of double), to which every
    row contributes; no rows are sampled. It is made here and now; with a convention nothing runs until rows are asked for.
    """
    ok = F.col(gain).isNotNull() & ~F.isnan(F.col(gain).cast("double")) & (F.col(gain) > 0) & (F.col(gain) < float("inf"))
    per = F.create_map(*[F.lit(x) for k, v in PER_MV.items() for x in (k, v)])
    df = channels.withColumn("_s", stated_scale(F.col(units), F.col(info))).withColumn("_range", range_mv(F.col(span)))
    by_range = F.when(F.col("_range").isNotNull() & (F.col(saturation) > 0), F.col(saturation) / F.col("_range"))
    g = F.when(ok, F.when(F.col("_s.inverse"), 1 / F.col(gain)).otherwise(F.col(gain)))
    df = (
        df.withColumn("_by_range", F.when(~F.col("_s.other"), by_range))
        .withColumn("_g", F.when(~F.col("_s.other") & F.col("_by_range").isNull(), g))
        .withColumn("_open", F.col("_g").isNotNull() & F.col("_s.unit").isNull())
    )
    if default in PER_MV:
        df = df.withColumn("_fit", F.when(F.col("_open"), F.struct(F.lit(default).alias("unit"), F.lit(1.0).alias("p"))))
    else:
        df = _fitted(df, bins_per_decade)
    open_ = F.col("_open")
    unit = F.coalesce(F.col("_s.unit"), F.col("_fit.unit"))
    return (
        df.withColumn("unit", F.when(F.col("_g").isNotNull(), unit))
        .withColumn("inverse", F.coalesce(F.col("_s.inverse") & F.col("_g").isNotNull(), F.lit(False)))
        .withColumn("scale_mv", F.coalesce("_by_range", F.col("_g") * per[F.col("unit")]))
        .withColumn("basis", F.when(F.col("_by_range").isNotNull(), "range").when(open_, "fitted").when(F.col("_g").isNotNull(), "stated"))
        .withColumn("posterior", F.when(open_, F.col("_fit.p")).when(F.col("basis").isNotNull(), 1.0))
        .withColumn("uncertain", F.coalesce(F.col("posterior") < sure, F.lit(False)))
        .drop("_s", "_range", "_by_range", "_g", "_open", "_fit")
    )
