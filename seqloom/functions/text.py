"""Sequence and identifier functions: Column -> Column, inside the JVM. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The allowed residues, and the characters that storage keys must not have.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYX"
FORBIDDEN = '<>:"/\\|?*\t\r\n'
BLANKS = " \t\r\n"


def strip_blanks(raw: Column) -> Column:
    """Upper case without blanks, tabs and line ends."""
    return F.regexp_replace(F.upper(raw), "[ \t\r\n]", "")


def sanitised(raw: Column) -> Column:
    """Allowed residues are kept, all else becomes X."""
    return F.regexp_replace(strip_blanks(raw), f"[^{RESIDUES}]", "X")


def fixed_count(raw: Column) -> Column:
    """The number of characters that `sanitised` changes; an X of the input is none."""
    return F.length(F.regexp_replace(strip_blanks(raw), f"[{RESIDUES}]", ""))


def printable(raw: Column) -> Column:
    """Upper case, printable ASCII without white space and stop marks."""
    return F.regexp_replace(F.upper(raw), r"[^\x21-\x7E]|\*", "")


def storage_key(name: Column, most: int = 240) -> Column:
    """A name without characters that keys must not have, at most 240 long, `unnamed` if nothing is left or null."""
    key = F.left(F.translate(F.trim(name), FORBIDDEN, "_" * len(FORBIDDEN)), F.lit(most))
    return F.coalesce(F.when(key != "", key), F.lit("unnamed"))


def safe_id(text: Column, most: int = 80) -> Column:
    """Runs of other characters than letters, digits and `_.|:+-` become `_`; longer ones end in ten digits of their SHA-1."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9_.|:+\-]+", "_")
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.left(plain, F.lit(most - 11)), F.lit("_"), F.left(F.sha1(text), F.lit(10))))


def base_id(chunk: Column) -> Column:
    """What is before the first `|chunk_`, else before the first `_chunk_`, else all."""
    return (
        F.when(F.instr(chunk, "|chunk_") > 0, F.substring_index(chunk, "|chunk_", 1))
        .when(F.instr(chunk, "_chunk_") > 0, F.substring_index(chunk, "_chunk_", 1))
        .otherwise(chunk)
    )


#: The two styles of chunk ids; the groups are parent, index, total, start and end.
LONG_STYLE = r"^(.*?)[|_]chunk_(\d+)_of_(\d+)[|_]aa_(\d+)_(\d+)$"
SHORT_STYLE = r"^(.*?)[|_]chunk_(\d+)_of_(\d+)$"


def parsed_chunk(chunk: Column) -> Column:
    """STRUCT<parent, index, total, start, end> of a chunk id; start and end are null in the short style, all is null for other ids."""
    number = lambda pattern, k: F.try_to_number(F.regexp_extract(chunk, pattern, k), F.lit("9" * 12)).cast("int")
    long_, short = chunk.rlike(LONG_STYLE), chunk.rlike(SHORT_STYLE)
    either = lambda k: F.when(long_, number(LONG_STYLE, k)).when(short, number(SHORT_STYLE, k))
    parent = F.when(long_, F.regexp_extract(chunk, LONG_STYLE, 1)).when(short, F.regexp_extract(chunk, SHORT_STYLE, 1))
    return F.struct(parent.alias("parent"), either(2).alias("index"), either(3).alias("total"), F.when(long_, number(LONG_STYLE, 4)).alias("start"), F.when(long_, number(LONG_STYLE, 5)).alias("end"))


def chunk_id(parent: Column, index: Column, total: Column, start: Column, end: Column, widen: bool = False) -> Column:
    """`parent|chunk_0001_of_0002|aa_000000_000300`; with `widen` indexes have as many digits as the total needs."""
    if not widen:
        return F.format_string("%s|chunk_%04d_of_%04d|aa_%06d_%06d", parent, index, total, start, end)
    width = F.greatest(F.lit(4), F.length(total.cast("string")))
    pad = lambda x, w: F.lpad(x.cast("string"), w, F.lit("0"))
    return F.concat(parent, F.lit("|chunk_"), pad(index, width), F.lit("_of_"), pad(total, width), F.lit("|aa_"), F.format_string("%06d_%06d", start, end))


def window_bounds(name: Column) -> Column:
    """STRUCT<s, e, mid> of a name like window_10_20; nulls if it has no window."""
    get = lambda k: F.nullif(F.regexp_extract(name, r"window_(\d+)_(\d+)", k), F.lit("")).cast("double")
    return F.struct(get(1).alias("s"), get(2).alias("e"), ((get(1) + get(2)) / 2).alias("mid"))


def to_number(text: Column) -> Column:
    """DOUBLE; null for empty, `-` and what is no number."""
    return F.nullif(F.nullif(F.trim(text), F.lit("")), F.lit("-")).try_cast("double")


def to_integer(text: Column) -> Column:
    """INT by way of a floating number, so that 3.7 gives 3; null for values that INT can't hold."""
    return to_number(text).try_cast("int")


def fixed_text(number: Column, digits: int) -> Column:
    """A number with fixed decimals; an empty text for null and NaN."""
    return F.when(number.isNull() | F.isnan(number), "").otherwise(F.format_string(f"%.{digits}f", number))


def key_values(text: Column, between: str = "\t", of: str = "=") -> Column:
    """MAP of `k=v` parts; parts without `=` are left out, of repeated keys the last one counts."""
    parts = F.filter(F.split(text, between), lambda p: F.instr(p, of) > 0)
    # the last of equal keys is kept: it is the first in reverse
    pairs = F.transform(F.reverse(parts), lambda p: F.struct(F.trim(F.substring_index(p, of, 1)).alias("k"), F.trim(F.substr(p, F.instr(p, of) + len(of))).alias("v")))
    firsts = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(firsts)


def fold_of(identifier: Column, folds: int, seed: int) -> Column:
    """A fold from the first 8 bytes of the SHA-1 of `seed<TAB>id`, as a big-endian number, modulo the folds."""
    head = F.substring(F.sha1(F.concat(F.lit(f"{seed}\t"), identifier)), 1, 16)
    return F.pmod(F.conv(head, 16, 10).cast("decimal(20,0)"), F.lit(folds)).cast("int")


def sequence_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def accession_base(acc: Column) -> Column:
    """An accession without its version."""
    return F.regexp_replace(F.trim(acc), r"\.\d+$", "")


def domain_label(primary: Column, fallback: Column) -> Column:
    """The first that isn't null, empty or `-`, with runs of white space as one blank."""
    known = lambda c: F.when(~F.trim(c).isin("", "-"), c)
    return F.trim(F.regexp_replace(F.coalesce(known(primary), known(fallback)), r"\s+", " "))


def safe_key(text: Column) -> Column:
    """Slashes become `_`."""
    return F.translate(text, "/", "_")


def safe_file_name(text: Column) -> Column:
    """Characters other than letters, digits and `._-` become `_`, one for each."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}._-]", "_")


# The full name of each model, by the names that stand for it.
MODEL_NAMES = {
    "300m": "esmc_300m",
    "esmc_300m": "esmc_300m",
    "esmc-300m": "esmc_300m",
    "600m": "esmc_600m",
    "esmc_600m": "esmc_600m",
    "esmc-600m": "esmc_600m",
    "6b": "esmc-6b-2024-12",
    "esmc_6b": "esmc-6b-2024-12",
    "esmc-6b": "esmc-6b-2024-12",
    "esmc-6b-2024-12": "esmc-6b-2024-12",
}
# Names of models that run on the spot.
LOCAL_MODELS = ("esmc_300m", "esmc_600m", "esmc-300m", "esmc-600m")


def model_name(name: Column) -> Column:
    """The full name of a model, whatever the case and blanks around; other names as they are."""
    known = F.create_map(*(F.lit(x) for pair in MODEL_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), name)


def is_local_model(name: Column) -> Column:
    return F.coalesce(F.lower(F.trim(name)).isin(*LOCAL_MODELS), F.lit(False))


def required_chunk(chunk: Column) -> Column:
    """As parsed_chunk, but an error for ids of another form."""
    parsed = parsed_chunk(chunk)
    return F.when(parsed["parent"].isNotNull() | chunk.isNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not a chunk id: "), chunk)))


def motif_centre(position: Column, *sequences: Column) -> Column:
    """The middle of a motif that begins at position, by the first sequence that isn't null or empty; the position if there is none."""
    seq = F.coalesce(*(F.nullif(s, F.lit("")) for s in sequences))
    return F.when(seq.isNotNull(), position + (F.length(seq) - 1) / 2.0).otherwise(position.cast("double"))


def noncanonical_order(order: Column) -> Column:
    """Whether an order of motifs is known and not ABC."""
    return F.coalesce(~F.upper(F.trim(order)).isin("", ".", "ABC"), F.lit(False))


def has_all_motifs(kv: Column) -> Column:
    """Whether a MAP has posA, posB and posC."""
    return F.coalesce(F.map_contains_key(kv, F.lit("posA")) & F.map_contains_key(kv, F.lit("posB")) & F.map_contains_key(kv, F.lit("posC")), F.lit(False))
