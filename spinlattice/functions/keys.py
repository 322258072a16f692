"""Musical keys and wheel codes as Column expressions.

A wheel code is a number 1 to 12 and a letter (A minor, B major). Every function is a built-in
expression tree: it stays inside code generation and folds on constants.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: wheel number of each major tonic, C first
MAJOR_NUMBER = [8, 3, 10, 5, 12, 7, 2, 9, 4, 11, 6, 1]
SHARP = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLAT = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
# fixed values: wheel codes of collection key numbers 0 to 23
XML_KEYS = ["8B", "9B", "10B", "11B", "12B", "1B", "2B", "3B", "4B", "5B", "6B", "7B", "5A", "6A", "7A", "8A", "9A", "10A", "11A", "12A", "1A", "2A", "3A", "4A"]
# fixed values: relation, label, risk, base score
RELATIONS = [
    ("same-key", "Same key", "low", 95), ("neighbor", "Neighbor move", "low", 85), ("mood-shift", "Mood shift", "low", 80), ("energy-boost", "Energy boost", "medium", 75),
    ("energy-drop", "Energy drop", "medium", 70), ("tension", "Tension jump", "high", 40), ("bridge-needed", "Bridge needed", "high", 20), ("unknown", "Unknown", "high", 0),
]
# fixed values: position relations and their labels
POSITIONS = {"same": "Same key", "plus_one": "+1 smooth", "minus_one": "-1 smooth", "plus_two": "+2 energy boost", "minus_two": "-2 energy drop", "mood_shift": "A↔B mood shift", "incompatible": "Clash"}
_CODE = r"^0*([1-9]|1[0-2])([AaBb])$"


def _array(values: list) -> Column:
    return F.array(*map(F.lit, values))


def number(code: Column) -> Column:
    """Wheel number, null for anything that is no code."""
    return F.nullif(F.regexp_extract(F.trim(code), _CODE, 1), F.lit("")).cast("int")


def is_major(code: Column) -> Column:
    """Whether the code's letter is B, null for anything that is no code."""
    return F.upper(F.nullif(F.regexp_extract(F.trim(code), _CODE, 2), F.lit(""))) == "B"


def key_to_camelot(tonic: Column, major: Column) -> Column:
    """Wheel code of a tonic pitch class and mode; minors stand on their relative major's number."""
    at = F.pmod(F.when(major, tonic).otherwise(tonic + 3), F.lit(12)).cast("int")
    return F.concat(F.get(_array(MAJOR_NUMBER), at).cast("string"), F.when(major, "B").otherwise("A"))


def tonic(code: Column) -> Column:
    """Pitch class of a code's tonic."""
    order = sorted(range(12), key=lambda t: MAJOR_NUMBER[t])
    of_major = F.get(_array(order), number(code) - 1)
    return F.when(is_major(code), of_major).when(~is_major(code), F.pmod(of_major + 9, F.lit(12))).cast("int")


def camelot_to_standard(code: Column) -> Column:
    """Such as ``A minor`` for 8A."""
    return F.concat(F.get(_array(SHARP), tonic(code)), F.when(is_major(code), " major").otherwise(" minor"))


def pitch_class(name: Column) -> Column:
    """Pitch class of a note name in sharps or flats."""
    names = {n: i for i, n in [*enumerate(FLAT), *enumerate(SHARP)]}
    return F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), name)


def parse_standard(name: Column, default_major: bool = False) -> tuple[Column, Column]:
    """(tonic, is_major) of ``Eb minor``; case-tolerant, text after a tab is dropped; ``default_major`` takes
    a note without a mode as major."""
    parts = F.split(F.trim(F.split(name, "\t")[0]), r"\s+")
    note = F.get(parts, F.lit(0))
    note = F.concat(F.upper(F.substring(note, 1, 1)), F.lower(note.substr(F.lit(2), F.length(note))))
    mode = F.lower(F.get(parts, F.lit(1)))
    major = F.when(mode.isin("major", "maj"), True).when(mode.isin("minor", "min"), False)
    if default_major:
        major = F.when(mode.isNull(), True).otherwise(major)
    pc = F.try_element_at(F.create_map(*(F.lit(x) for i in range(12) for n in {SHARP[i], FLAT[i]} for x in (n, i))), note)
    return F.when(major.isNotNull(), pc), F.when(pc.isNotNull(), major)


def standard_to_camelot(name: Column) -> Column:
    """C4: wheel code of a standard name, sharps and flats."""
    t, m = parse_standard(name)
    return F.when(t.isNotNull() & m.isNotNull(), key_to_camelot(t, m))


def xml_key(code: Column) -> Column:
    """Wheel code of a collection's key number."""
    return F.get(_array(XML_KEYS), code.cast("int"))


def label24(tonic_: Column, major: Column) -> Column:
    """Class 0 to 23, minors from 12."""
    return tonic_ + F.when(major, 0).otherwise(12)


def from_label24(label: Column) -> tuple[Column, Column]:
    """(tonic, is_major) of a class."""
    return F.pmod(label, F.lit(12)), label < 12


def compatible_positions(code: Column) -> Column:
    """Array of the six codes that mix with a code: itself, one and two steps either way, the other letter."""
    n, letter = number(code), F.when(is_major(code), "B").otherwise("A")
    at = lambda k: F.concat((F.pmod(n + (k - 1), F.lit(12)) + 1).cast("string"), letter)
    other = F.concat(n.cast("string"), F.when(is_major(code), "A").otherwise("B"))
    return F.when(n.isNotNull(), F.array(at(0), at(1), at(-1), at(2), at(-2), other))


def step(a: Column, b: Column) -> Column:
    """Steps clockwise from a to b, 0 to 11."""
    return F.pmod(number(b) - number(a), F.lit(12))


def relation(a: Column, b: Column) -> Column:
    """One of eight classes."""
    return F.when(number(a).isNull() | number(b).isNull(), "unknown").otherwise(parsed_relation(step(a, b), is_major(a) == is_major(b)))


def parsed_relation(d: Column, same: Column) -> Column:
    """C9 of two codes ``d`` steps around the wheel apart, of the same letter or not."""
    return (
        F.when((d == 0) & same, "same-key").when(d == 0, "mood-shift").when(~same, "bridge-needed")
        .when(d.isin(1, 11), "neighbor").when(d == 2, "energy-boost").when(d == 10, "energy-drop").otherwise("tension")
    )


def relation_label(rel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r in RELATIONS for x in (r[0], r[1]))), rel)


def relation_risk(rel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r in RELATIONS for x in (r[0], r[2]))), rel)


def base_score(rel: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for r in RELATIONS for x in (r[0], r[3]))), rel)


def position(a: Column, b: Column) -> Column:
    """Directed position relation, null if either is no code."""
    d, same = step(a, b), is_major(a) == is_major(b)
    return (
        F.when(d.isNull(), None).when((d == 0) & same, "same").when(d == 0, "mood_shift").when(~same, "incompatible").when(d == 1, "plus_one")
        .when(d == 11, "minus_one").when(d == 2, "plus_two").when(d == 10, "minus_two").otherwise("incompatible")
    )


def position_label(pos: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in POSITIONS.items() for x in p)), pos)


@dataclass(frozen=True)
class Rules:
    """Which moves a playlist allows; each pair of step flags acts as one switch."""

    same_key: bool = True
    plus_one: bool = True
    minus_one: bool = True
    plus_two: bool = True
    minus_two: bool = True
    dominant_to_subdominant: bool = True
    subdominant_to_dominant: bool = True


def compatibility(a: Column, b: Column, rules: Rules = Rules()) -> Column:
    """C11: weight 0 to 1 of a move under ``rules``. The diagonal that counts is A to B one step back,
    B to A one step on; it needs no flag."""
    return parsed_compatibility(a == b, (number(a), is_major(a)), (number(b), is_major(b)), rules)


def parsed_compatibility(equal: Column, a: tuple[Column, Column], b: tuple[Column, Column], rules: Rules = Rules()) -> Column:
    """C11 of codes whose numbers and modes are known, and whether their texts are equal: for pairs, where parsing would be once a pair."""
    (an, am), (bn, bm) = a, b
    d, same = F.pmod(bn - an, F.lit(12)), am == bm
    on = lambda flag, x: F.lit(x if flag else 0.0)
    diagonal = F.when(am, d == 1).otherwise(d == 11)
    return (
        F.when(equal, on(rules.same_key, 1.0)).when(d.isNull(), 0.0).when(same & d.isin(1, 11), on(rules.plus_one or rules.minus_one, 0.9))
        .when(same & d.isin(2, 10), on(rules.plus_two or rules.minus_two, 0.7)).when(~same & (d == 0) & ~am, on(rules.dominant_to_subdominant, 0.8))
        .when(~same & (d == 0), on(rules.subdominant_to_dominant, 0.8)).when(~same & diagonal, 0.6).otherwise(0.0)
    )


def delta_percent(a_bpm: Column, b_bpm: Column) -> Column:
    return F.when((a_bpm > 0) & b_bpm.isNotNull(), (b_bpm - a_bpm) / a_bpm * 100).otherwise(F.lit(0.0))


def transition_score(rel: Column, delta: Column) -> Column:
    """Base score less up to 20 for tempo jumps over 6 percent; halves round up."""
    return less_jump(base_score(rel), delta)


def less_jump(base: Column, delta: Column) -> Column:
    """C12 of a known base score."""
    over = F.abs(delta)
    cut = F.when(over > 6, F.least(F.lit(20), F.floor((over - 6) * 2 + 0.5))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base - cut)).cast("int")


def delta_text(delta: Column) -> Column:
    """Such as ``+4.2%`` for jumps over 3 percent, else empty."""
    return F.when(F.abs(delta) > 3, F.concat(F.when(delta > 0, "+").otherwise(""), F.format_string("%.1f", delta), F.lit("%"))).otherwise("")


def is_compatible(a: Column, b: Column) -> Column:
    """Whether b is among a's six positions."""
    d, same = step(a, b), is_major(a) == is_major(b)
    return F.coalesce((same & d.isin(0, 1, 2, 10, 11)) | (~same & (d == 0)), F.lit(False))


def strength(a: Column, b: Column) -> Column:
    """3 same, 2 a step or the other letter, 1 two steps, else 0."""
    d, same = step(a, b), is_major(a) == is_major(b)
    return F.when(d.isNull(), 0).when((d == 0) & same, 3).when(d == 0, 2).when(same & d.isin(1, 11), 2).when(same & d.isin(2, 10), 1).otherwise(0)


def ambiguity(winner: Column, other: Column) -> Column:
    """C14: relation of two standard key names, first match of an ordered list. Names are parsed once: what follows sees the parsed ones bound."""
    (wt, wm), (ot, om) = parse_standard(winner, True), parse_standard(other, True)
    wheel_of = lambda t, m: F.get(_array(MAJOR_NUMBER), F.pmod(F.when(m, t).otherwise(t + 3), F.lit(12)).cast("int"))

    def kind(x: Column) -> Column:
        wt, wm, ot, om, wn, on = (x[f] for f in ("wt", "wm", "ot", "om", "wn", "on"))
        d, wheel = F.pmod(ot - wt, F.lit(12)), F.abs(wn - on)
        return (
            F.when(x["same"], "same").when(wt.isNull() | ot.isNull() | wm.isNull() | om.isNull(), "distant").when((wt == ot) & (wm != om), "parallel")
            .when((wn == on) & (wm != om), "relative").when((wm == om) & wheel.isin(1, 11), "close_wheel").when((d == 7) & (wm == om), "dominant")
            .when((d == 5) & (wm == om), "subdominant").when((wn == on) & (wm == om), "enharmonic").otherwise("distant")
        )

    parsed = F.array(F.struct((winner == other).alias("same"), wt.alias("wt"), wm.alias("wm"), ot.alias("ot"), om.alias("om")))
    placed = F.transform(parsed, lambda x: F.struct(*(x[f].alias(f) for f in ("same", "wt", "wm", "ot", "om")), wheel_of(x["wt"], x["wm"]).alias("wn"), wheel_of(x["ot"], x["om"]).alias("on")))
    return F.get(F.transform(placed, kind), F.lit(0))


def canonical(code: Column) -> Column:
    """The code as the 24 keys write it, null for anything that is no code; those that are so written already are not parsed."""
    return F.when(code.isin([f"{n}{x}" for n in range(1, 13) for x in "AB"]), code).otherwise(F.concat(number(code).cast("string"), F.when(is_major(code), "B").otherwise("A")))


def by_codes(rows: DataFrame, a: str, b: str, values: dict[str, tuple[Callable[[Column, Column], Column], object]], of: str = "code") -> DataFrame:
    """``rows`` with columns that depend on two wheel codes alone: each is (a function of the ``of`` of both, its value where either is no code).

    They are worked out once for each of the 24 by 24 pairs of codes and looked up, so a row parses nothing and evaluates no rule."""
    dim = dim_key(rows.sparkSession).select("code", of)
    matrix = dim.select(F.col("code").alias("_a"), F.col(of).alias("_x")).crossJoin(dim.select(F.col("code").alias("_b"), F.col(of).alias("_y")))
    matrix = matrix.select("_a", "_b", *(f(F.col("_x"), F.col("_y")).alias(f"_{name}") for name, (f, _) in values.items()))
    told = rows.withColumns({"_ca": canonical(F.col(a)), "_cb": canonical(F.col(b))}).join(F.broadcast(matrix), (F.col("_ca") == F.col("_a")) & (F.col("_cb") == F.col("_b")), "left")
    found = told.withColumns({name: F.coalesce(f"_{name}", F.lit(none)) for name, (_, none) in values.items()})
    return found.drop("_a", "_b", "_ca", "_cb", *(f"_{name}" for name in values))


def dim_key(spark: SparkSession) -> DataFrame:
    """The 24 keys: code, number, is_major, tonic, name, label24. Small by construction, so joins broadcast it; literal rows, so no Python task makes them."""
    rows = []
    for major in (False, True):
        for t in range(12):
            n = MAJOR_NUMBER[t if major else (t + 3) % 12]
            rows.append(f"('{n}{'B' if major else 'A'}', {n}, {major}, {t}, '{SHARP[t]} {'major' if major else 'minor'}', {t + (0 if major else 12)})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS k(code, number, is_major, tonic, name, label24)")
