"""Audio signals as arrays of numbers."""

from __future__ import annotations

from spanloom.functions.dialect import Spark


def scaled(d: Spark, a: str, volume: float) -> str:
    """Times the volume; none at 0 and below, unchanged at 1 and above."""
    v = min(1.0, max(0.0, volume))
    return a if v == 1 else d.each(a, lambda x: f"cast({x} as double) * cast({v} as double)")


def loud(d: Spark, a: str, threshold: float) -> str:
    """Whether each sample is above the threshold."""
    return d.each(a, lambda x: f"(abs(cast({x} as double)) > cast({threshold} as double))")


def trimmed(d: Spark, a: str, flags: str, pad: int) -> str:
    """Without what is quiet at either end, but for ``pad`` samples; the last loud one is the first that the pad counts. Quiet signals stay."""
    if d.name == "duck":
        first, last = f"list_position({flags}, true)", f"(len({flags}) + 1 - list_position(list_reverse({flags}), true))"
        low, high = f"greatest({first} - 1 - {pad}, 0)", f"least({last} - 1 + {pad}, len({a}))"
        return f"case when {first} is null or {first} = 0 or {high} <= {low} then {a} else {a}[{low} + 1:{high}] end"
    first, last = f"array_position({flags}, true)", f"(size({flags}) + 1 - array_position(reverse({flags}), true))"
    low, high = f"greatest({first} - 1 - {pad}, 0)", f"least({last} - 1 + {pad}, size({a}))"
    return f"case when {first} = 0 or {high} <= {low} then {a} else slice({a}, cast({low} + 1 as int), cast(greatest({high} - {low}, 0) as int)) end"


def resampled(d: Spark, a: str, rate: float) -> str:
    """As many samples as the rate asks for, half to even and at least one, on straight lines between the old ones."""
    n = d.size(a)
    new = f"greatest(1, cast({d.half_even(f'{n} / cast({rate} as double)')} as int))"
    step = f"(cast({n} - 1 as double) / greatest({new} - 1, 1))"

    def value(i: str) -> str:
        at = f"(cast({i} as double) * {step})"
        low = f"cast(floor({at}) as int)"
        get = (lambda k: f"cast({a}[{k} + 1] as double)") if d.name == "duck" else (lambda k: f"cast(element_at({a}, {k} + 1) as double)")
        high = f"least({low} + 1, {n} - 1)"
        return f"{get(low)} + ({at} - {low}) * ({get(high)} - {get(low)})"

    steps = f"range(0, {new})" if d.name == "duck" else f"sequence(0, {new} - 1)"
    return f"case when {n} = 0 then {a} else {d.each(steps, value, 'i')} end"


def resampled_channels(d: Spark, channels: list[str], rate: float) -> str:
    """Frames of several channels (an array of arrays). Each is resampled, and all are cut to the shortest."""
    sizes = [f"case when {d.size(c)} = 0 then 0 else greatest(1, cast({d.half_even(f'{d.size(c)} / cast({rate} as double)')} as int)) end" for c in channels]
    n = f"least({', '.join(sizes)})" if len(sizes) > 1 else sizes[0]
    made = ", ".join(resampled(d, c, rate) for c in channels)
    if d.name == "duck":
        return f"list_zip({made})[1:{n}]"
    return f"transform(slice(arrays_zip({made}), 1, {n}), z -> array({', '.join(f'z.`{k}`' for k in range(len(channels)))}))"


def rate_valid(rate: str) -> str:
    """The rate, which must be from 0.75 to 2; another is an error."""
    return f"case when {rate} between 0.75 and 2.0 then {rate} else raise_error('rate out of range') end"


def volume_clamped(volume: str) -> str:
    return f"least(greatest({volume}, 0.0), 1.0)"


def played_ms(d: Spark, frames: str, sample_rate: str, rate: str) -> str:
    """Milliseconds of the original that so many frames are, both steps rounded down."""
    return f"cast(floor(floor({frames} * 1000.0 / {sample_rate}) * {rate}) as bigint)"
