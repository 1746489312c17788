"""Scalar functions: names, labels, probabilities, arrays; all of them JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name without its last extension; a leading dot is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def category(x: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", ""))


def named_parts(name: Column, pattern: str, fields: list[str], numbers: tuple[str, ...] = ()) -> Column:
    """struct of the pattern's groups, null where it doesn't match; fields in numbers are cast to long."""
    parts = [F.regexp_extract(name, pattern, i + 1).cast("long" if f in numbers else "string").alias(f) for i, f in enumerate(fields)]
    return F.when(name.rlike(pattern), F.struct(*parts))


#: fold-clip-take-target of environmental sound clips, such as 1-100032-A-0.wav.
CLIP = (r"^(\d)-(\d+)-([A-Z])-(\d+)\.wav$", ["fold", "clip", "take", "target"], ("fold", "clip", "target"))
#: type, speed and event number of flight events, such as quad_12_e03.
FLIGHT = (r"^([A-Za-z0-9]+)_(\d+)_e(\d+)$", ["subtype", "speed", "event_index"], ("speed", "event_index"))


#: Patterns of names. Archives by rotor, device and vehicle; members by height, distance, date and number;
#: flights by vehicle, manoeuvre and number.
ARCHIVE = (r"(?i)^(X[46])_(D\d+)_(.+)\.zip$", ["rotor", "drone", "vehicle"], ())
MEMBER = (r"(?i)_(\d+)m_(\d+)m_(\d{6})_+(\d+)(?:_[^.]+)?\.wav$", ["height", "distance", "date", "measurement"], ("height", "distance", "measurement"))
MANOEUVRE = (r"^data/([a-z0-9]+)_(flyover|hover)_([0-9]+)\.mat$", ["vehicle", "manoeuvre", "flight"], ("flight",))
#: Dates in names, as 2024-01-31 with any or no separator, or as six digits on their own.
DATE = r"20\d{2}[-_.]?\d{2}[-_.]?\d{2}|(?<!\d)\d{6}(?!\d)"


def labelled_flight(name: Column, labels: dict[str, int], groups: dict[str, str] | None = None) -> Column:
    """struct(vehicle, manoeuvre, flight, label, acquisition_group) of a member's name; null for other names.

    A vehicle without a label is an error.
    """
    parts = named_parts(name, *MANOEUVRE)
    vehicle = parts.getField("vehicle")
    of = lambda table, kind: F.coalesce(*[F.when(vehicle == k, v) for k, v in table.items()], F.lit(None).cast(kind))
    unknown = F.raise_error(F.concat(F.lit("no label for the vehicle "), vehicle)).cast("int")
    made = F.struct(*[parts.getField(f).alias(f) for f in MANOEUVRE[1]], F.coalesce(of(labels, "int"), unknown).alias("label"), of(groups or {}, "string").alias("acquisition_group"))
    return F.when(name.rlike(MANOEUVRE[0]), made)


def group_and_condition(path: Column, marker: str = "_paperdist_") -> Column:
    """struct(source_group, condition) of a recording's name: what stands before the marker, and the T with two digits."""
    name = stem(path)
    condition = F.nullif(F.regexp_extract(name, r"_(T\d{2})_", 1), F.lit(""))
    return F.struct(F.substring_index(name, marker, 1).alias("source_group"), F.coalesce(condition, F.lit("unknown")).alias("condition"))


def keyword(text: Column, words: list[str], other: str = "other") -> Column:
    """The first of the words that the text holds, in any case."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(w.lower()), F.lit(w)) for w in words], F.lit(other))


def device(path: Column, names: dict[str, str], other: str = "unknown") -> Column:
    """The name of the device whose token the path holds, in any case."""
    up = F.upper(path)
    return F.coalesce(*[F.when(up.contains(token.upper()), F.lit(name)) for token, name in names.items()], F.lit(other))


def date_in(name: Column) -> Column:
    """The first date in a name as digits only (eight, or six with a two-digit year); null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(name, DATE, 0), "[-_.]", ""), F.lit(""))


def filled(template: str, **values: Column) -> Column:
    """The template with its {names} replaced by columns."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def truthy(x: Column) -> Column:
    """Whether the text is 1, true, yes or y, in any case; null and all else: false."""
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def snr_label(x: Column) -> Column:
    """snr_+10_db."""
    return F.format_string("snr_%+.0f_db", x.cast("double"))


def dash_field(x: Column, place: int) -> Column:
    """The place-th (from 0) of fields between dashes; null if there are fewer."""
    return F.get(F.split(x, "-"), F.lit(place))


def sigmoid(x: Column, temperature: float = 1.0) -> Column:
    """Without overflow on either side."""
    z = x / temperature
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column, edge: float = 1e-8) -> Column:
    q = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(q / (1 - q))


def ceil_scaled(n: Column, numerator: int, denominator: int) -> Column:
    """ceil(n * numerator / denominator) in integers."""
    return F.floor((n.cast("long") * numerator + denominator - 1) / denominator).cast("long")


def hz_to_mel(f: Column) -> Column:
    return 2595.0 * F.log10(1 + f / 700.0)


def mel_to_hz(m: Column) -> Column:
    return 700.0 * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def rms(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x)) / F.size(a))


def rms_dbfs(a: Column) -> Column:
    return 10 * F.log10(_sum(F.transform(a, lambda x: x.cast("double") * x)) / F.size(a) + 1e-12)


def peak(a: Column) -> Column:
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))


def peak_normalised(a: Column, silence: float = 1e-8) -> Column:
    """Samples over the largest magnitude; a silent signal becomes zeros."""
    top = peak(a)
    return F.transform(a, lambda x: F.when(top > silence, x.cast("double") / top).otherwise(0.0))


def degenerate(a: Column, silence: float = 1e-8, flat: float = 1e-4) -> Column:
    """Whether a signal is silent, or varies less than flat."""
    n = F.size(a)
    mean = _sum(F.transform(a, lambda x: x.cast("double"))) / n
    spread = F.sqrt(_sum(F.transform(a, lambda x: (x - mean) * (x - mean))) / n)
    return (peak(a) <= silence) | (spread < flat)


def fitted_length(a: Column, size: int) -> Column:
    """The centre of a longer array; a shorter one repeated up to size."""
    n = F.size(a)
    looped = F.slice(F.flatten(F.array_repeat(a, F.ceil(F.lit(size) / F.greatest(n, F.lit(1))).cast("int"))), 1, size)
    return F.when(n >= size, F.slice(a, (F.floor((n - size) / 2) + 1).cast("int"), F.lit(size))).otherwise(looped)


def padded(a: Column, size: int) -> Column:
    """The array with zeros up to size."""
    return F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(size) - F.size(a), F.lit(0))))


def sliced(a: Column, start: Column, end: Column) -> Column:
    """Samples from start to before end; both or neither, and in range, else an error; neither: all."""
    both = start.isNotNull() & end.isNotNull()
    fine = both & (start >= 0) & (end > start) & (end <= F.size(a))
    wrong = F.raise_error(F.lit("a sample range must be whole and within the signal")).cast("array<float>")
    return F.when(start.isNull() & end.isNull(), a).when(fine, F.slice(a, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(wrong)


def register(spark) -> list[str]:
    """Temporary SQL functions of the same kind, for use in SQL text; their names."""
    made = {
        "lf_category": ("x STRING", "STRING", "upper(regexp_replace(x, '[^0-9A-Za-z]', ''))"),
        "lf_compact": ("x STRING", "STRING", "regexp_replace(lower(x), '[^a-z0-9]', '')"),
        "lf_sigmoid": ("x DOUBLE", "DOUBLE", "CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END"),
        "lf_logit": ("p DOUBLE", "DOUBLE", "ln(least(greatest(p, 1e-8), 1 - 1e-8) / (1 - least(greatest(p, 1e-8), 1 - 1e-8)))"),
        "lf_hz_to_mel": ("f DOUBLE", "DOUBLE", "2595.0 * log10(1 + f / 700.0)"),
        "lf_seeded_rank": ("seed STRING, key STRING", "STRING", "sha2(concat_ws(':', seed, key), 256)"),
    }
    for name, (args, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(made)
