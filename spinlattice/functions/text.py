"""Text, genre, path and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keys

# fixed values: genre classes in order of precedence, and the substrings that lead to them
GENRES = [
    ("electronic", ["electr", "edm", "dance"]),
    ("house", ["house"]),
    ("techno", ["techno"]),
    ("trance", ["trance", "psy"]),
    ("bass", ["dubstep", "drum", "bass", "riddim"]),
    ("hip-hop", ["hip", "hop", "rap", "trap"]),
    ("r&b", ["r&b", "r'n'b", "r-n-b", "soul", "funk"]),
    ("rock", ["rock", "punk", "metal", "guitar"]),
    ("pop", ["pop", "top 40", "top40"]),
    ("reggae-latin", ["reggae", "dancehall", "shatta", "salsa", "latin", "ragga"]),
    ("classical", ["classical", "orchestr", "soundtrack", "score", "theme", "anime"]),
    ("jazz", ["jazz", "blues", "swing"]),
    ("ambient", ["chill", "ambient", "lounge"]),
    ("world", ["world", "folk", "acoustic", "country"]),
]
UNKNOWN_GENRES = ["", "unknown", "unknown genre", "unclassifiable", "various"]
# fixed values: profile weights (krumhansl, temperley, shaath) by genre family, in order, and the default
FAMILIES = [
    (["electronic", "edm", "house", "techno", "trance", "dubstep", "drum & bass", "dnb", "garage", "bass", "disco", "synth", "ambient", "idm", "breakbeat", "electro", "minimal"], (0.3, 0.4, 0.6)),
    (["classical", "orchestral", "symphony", "baroque", "chamber", "opera", "piano", "string quartet", "concerto"], (0.6, 0.5, 0.3)),
    (["rock", "pop", "indie", "alternative", "punk", "metal", "folk", "country", "blues"], (0.3, 0.6, 0.4)),
    (["hip", "hop", "rap", "r&b", "rnb", "soul", "trap", "funk"], (0.2, 0.4, 0.5)),
    (["jazz", "swing", "bebop", "fusion", "smooth jazz"], (0.5, 0.5, 0.3)),
]
DEFAULT_WEIGHTS = (0.15, 0.25, 1.0)


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def normalize_genre(raw: Column) -> Column:
    """One of sixteen classes; the first rule that matches wins, null is unknown."""
    g = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(g.isin(*UNKNOWN_GENRES), "unknown")
    for name, parts in GENRES:
        out = out.when(_any(g, parts), name)
    return out.otherwise("other")


def profile_weights(genre: Column) -> Column:
    """C20: struct of the three profile families' weights for a raw genre."""
    g = F.lower(F.coalesce(genre, F.lit("")))
    pack = lambda w: F.struct(*(F.lit(x).alias(n) for x, n in zip(w, ("krumhansl", "temperley", "shaath"), strict=True)))
    out = F.when(g == "", pack(DEFAULT_WEIGHTS))
    for parts, w in FAMILIES:
        out = out.when(_any(g, parts), pack(w))
    return out.otherwise(pack(DEFAULT_WEIGHTS))


def normalize_text(s: Column) -> Column:
    """Lower case, letters, digits and single spaces only; other white space separates no words."""
    kept = F.regexp_replace(F.lower(s), r"[^\p{IsAlphabetic}\p{N} ]", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def tokens(s: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(normalize_text(s), " "), ""))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity of two token arrays; 0 if either is empty."""
    shared, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every > 0, shared / F.greatest(every, F.lit(1))).otherwise(0.0)


def parse_filename(name: Column) -> tuple[Column, Column]:
    """(artist, title) of a file name; one leading digit or space goes from an artist, a whole number from a bare title."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    sep = F.when(stem.contains(" - "), " - ").when(stem.contains("_-_"), "_-_")
    at = F.when(stem.contains(" - "), F.locate(" - ", stem)).otherwise(F.locate("_-_", stem))
    artist = F.trim(F.regexp_replace(F.trim(stem.substr(F.lit(1), at - 1)), r"^[\p{N} ]", ""))
    title = F.trim(stem.substr(at + 3, F.length(stem)))
    bare = F.regexp_replace(stem, r"^[\p{N}_ .]+", "")
    return F.when(sep.isNull(), "").otherwise(artist), F.when(sep.isNull(), bare).otherwise(title)


def normalize_path(p: Column) -> Column:
    """Backslashes only."""
    return F.translate(p, "/", "\\")


def basename(p: Column) -> Column:
    return F.element_at(F.split(normalize_path(p), r"\\"), -1)


def collection_dir(d: Column) -> Column:
    """Directory of a collection entry without the local host's prefix; separators may be written ``/:``."""
    return F.replace(F.replace(d, F.lit("file://localhost/"), F.lit("")), F.lit("/:"), F.lit("/"))


def transition_sentence(a: Column, b: Column, a_bpm: Column, b_bpm: Column) -> Column:
    """Relation label and a note on tempo."""
    d = F.abs((b_bpm - a_bpm) / a_bpm * 100)
    note = F.when(d.isNull(), "BPM unknown.").when(d < 2, "BPM is nearly matched.").when(d < 8, F.concat(F.lit("BPM shifts "), F.format_string("%.0f", F.rint(d)), F.lit("% — manageable."))).otherwise(F.concat(F.lit("BPM jumps "), F.format_string("%.0f", F.rint(d)), F.lit("% — risky without pitch adjustment.")))
    return F.concat_ws(" ", keys.relation_label(keys.relation(a, b)), note)


def dimensions(a: Column, b: Column, a_bpm: Column, b_bpm: Column, a_energy: Column, b_energy: Column) -> Column:
    """Struct of harmonic, tempo and energy verdicts of a transition."""
    return verdicts(harmonic_verdict(a, b), a_bpm, b_bpm, a_energy, b_energy)


def harmonic_verdict(a: Column, b: Column) -> Column:
    """Of two codes."""
    pos = keys.position(a, b)
    return F.when(pos.isNull(), "warn").when(pos.isin("same", "plus_one", "minus_one"), "good").when(pos == "incompatible", "risk").otherwise("ok")


def verdicts(harmonic: Column, a_bpm: Column, b_bpm: Column, a_energy: Column, b_energy: Column) -> Column:
    """C26 with the harmonic verdict known."""
    share = F.abs(a_bpm - b_bpm) / F.least(a_bpm, b_bpm)
    tempo = F.when(share.isNull(), "warn").when(share < 0.02, "good").when(share < 0.08, "ok").otherwise("warn")
    delta = b_energy - a_energy
    energy = F.when(delta.isNull(), "warn").when(delta > 2, "good").otherwise("ok")
    return F.struct(harmonic.alias("harmonic"), tempo.alias("tempo"), energy.alias("energy"))


NOTES = "struct<type:string,clipNotes:array<struct<position:int,notes:string>>>"
PLAN = "struct<overlap_beats:double,master_bpm:double,tempo_master:string>"


def build_notes(clips: Column) -> Column:
    """The mix-notes JSON of an array of (position, notes)."""
    return F.to_json(F.struct(F.lit("mix").alias("type"), clips.alias("clipNotes")))


def parse_notes(js: Column) -> Column:
    """Array of (position, notes); unparseable JSON is null."""
    return F.from_json(js, NOTES)["clipNotes"]


def parse_plan(js: Column) -> Column:
    """A transition plan's struct; unparseable JSON has null fields."""
    return F.from_json(js, PLAN)
