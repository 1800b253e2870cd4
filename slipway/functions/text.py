"""Rules for paths, slugs, templates and messages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipway import constants as C


def strip(text: Column) -> Column:
    """White space removed at both ends, for every character Python calls white space."""
    return F.trim(text, F.lit(C.WHITE_SPACE))


def strip_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(C.WHITE_SPACE))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(C.WHITE_SPACE))


def normalize_provider(provider: Column) -> Column:
    """Lower-case provider name, the first provider when blank, null when unsupported."""
    name = F.lower(strip(F.coalesce(provider, F.lit(""))))
    name = F.when(name == "", F.lit(C.PROVIDERS[0])).otherwise(name)
    return F.when(name.isin(*C.PROVIDERS), name)


def volume_ignored(provider: Column, auto_volume: Column, volume_id: Column) -> Column:
    """True when a volume was asked for but the provider has none."""
    name = F.lower(strip(F.coalesce(provider, F.lit(""))))
    other = ~name.isin("", C.PROVIDERS[0])
    asked = F.coalesce(auto_volume, F.lit(False)) | (strip(F.coalesce(volume_id, F.lit(""))) != "")
    return other & asked


def model_slug(model_id: Column) -> Column:
    slug = F.regexp_replace(F.lower(strip(model_id)), r"[^\p{L}\p{N}\-_.]", "-")
    slug = F.regexp_replace(slug, r"\A-+|-+\z", "")
    return F.when(slug == "", F.lit("model")).otherwise(slug)


def _fill(text: Column, marker: str, value_of) -> Column:
    """``text`` with every match of ``marker`` replaced, in one pass over the text."""
    pieces = F.split(text, marker, -1)
    marks = F.regexp_extract_all(text, F.lit(f"({marker})"), F.lit(1))
    filled = F.transform(marks, value_of)
    return F.array_join(
        F.zip_with(pieces, filled, lambda piece, value: F.concat(piece, F.coalesce(value, F.lit("")))), ""
    )


def _literal_map(values: Mapping[str, str]) -> Column:
    pairs = [part for key, value in values.items() for part in (F.lit(key), F.lit(value))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def expand_variables(text: Column, variables: Mapping[str, str]) -> Column:
    """``$NAME`` and ``${NAME}`` from ``variables``; undefined ones stay as written."""
    known = _literal_map(variables)
    return _fill(
        text,
        r"\$(?:[A-Za-z0-9_]+|\{[^}]*\})",
        lambda mark: F.coalesce(
            F.try_element_at(known, F.regexp_replace(mark, r"\A\$\{?|\}\z", "")), mark
        ),
    )


def expand_keys(text: Column, values: Column) -> Column:
    """``{key}`` from a map column; unknown keys stay as written, ``{{`` and ``}}`` are braces."""
    return _fill(
        text,
        r"\{\{|\}\}|\{[A-Za-z_][A-Za-z0-9_]*\}",
        lambda mark: F.when(mark == "{{", F.lit("{"))
        .when(mark == "}}", F.lit("}"))
        .otherwise(F.coalesce(F.try_element_at(values, F.regexp_replace(mark, r"[{}]", "")), mark)),
    )


def has_part(rel_path: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(rel_path, "/"), F.array(*[F.lit(name) for name in names]))


def code_suffix(rel_path: Column) -> Column:
    """The file's suffix (".py"), empty for none; a leading dot starts a name, not a suffix."""
    return F.regexp_extract(rel_path, r"[^/](\.[^./]*)\z", 1)


def is_bundled(rel_path: Column) -> Column:
    """True unless a path part is an excluded name or a dotenv file."""
    dotenv = rel_path.rlike(r"(\A|/)\.env(\.[^/]*)?(/|\z)")
    return ~has_part(rel_path, C.BUNDLE_EXCLUDED) & ~dotenv


def command_for_file(file_name: Column, run_root: str) -> Column:
    """Start command of a single code file, null when its suffix is not known."""
    base = F.regexp_extract(file_name, r"([^/]*)\z", 1)
    suffix = code_suffix(file_name)
    target = F.concat(F.lit(f"{run_root}/"), base)
    return F.when(suffix == ".py", F.concat(F.lit("python "), target)).when(
        suffix.isin(".sh", ".bash"), F.concat(F.lit("bash "), target)
    )


def classify_launch_error(message: Column) -> Column:
    lowered = F.lower(message)
    balance = F.contains(lowered, F.lit(C.BALANCE_WORDS[0]))
    for word in C.BALANCE_WORDS[1:]:
        balance = balance | F.contains(lowered, F.lit(word))
    volume = F.contains(message, F.lit(C.VOLUME_ERROR_TEXTS[0])) & F.contains(
        message, F.lit(C.VOLUME_ERROR_TEXTS[1])
    )
    return (
        F.when(balance, F.lit("balance"))
        .when(F.contains(message, F.lit(C.FAILED_JOB_TEXT)), F.lit("remote_job"))
        .when(volume, F.lit("volume"))
        .when(F.contains(message, F.lit(C.POD_ERROR_TEXT)), F.lit("pod"))
        .otherwise(F.lit("other"))
    )


# Fixed value: where an error text lists the data centers.
DATA_CENTERS = rf"Available data centers:{C.BLANK}*([^\n]*?)(?:\"|\.|\n?\z)"


def data_centers(message: Column) -> Column:
    """Names listed after "Available data centers:", an empty array when there is no list."""
    listed = strip(F.regexp_extract(message, DATA_CENTERS, 1))
    names = F.split(listed, rf"{C.BLANK}*,{C.BLANK}*", -1)
    return F.when(message.rlike(DATA_CENTERS), names).otherwise(F.array().cast("array<string>"))
