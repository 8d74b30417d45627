"""Column expressions for labels, image names, missing text and seeded randomness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from postweave.schema import DISPLAY_NAMES, LABEL_CODES


def encode_label(label: Column, mapping: Mapping[str, int] = LABEL_CODES) -> Column:
    """Name to code; a name outside the mapping becomes NULL."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), label).cast("int")


def decode_label(code: Column, mapping: Mapping[str, int] = LABEL_CODES) -> Column:
    """Code to name; NULL for a code outside the mapping."""
    pairs = [F.lit(v) for name, c in mapping.items() for v in (c, name)]
    return F.try_element_at(F.create_map(*pairs), code)


def display_label(code: Column, names: Sequence[str] = DISPLAY_NAMES) -> Column:
    """Code to the display name at that position; NULL outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), code)


def normalize_extension(image: Column) -> Column:
    """Every literal ``.JPG`` becomes ``.jpg``; other spellings stay."""
    return F.replace(image, F.lit(".JPG"), F.lit(".jpg"))


def media_path(
    root: str, image: Column, folder: Column | None = None, on_absolute: str = "null"
) -> Column:
    """``root/folder/images/image``, or the flat ``root/image`` without a folder.

    A NULL part gives NULL. An absolute image name would leave the root: it gives
    NULL too, or with ``on_absolute='keep'`` replaces the whole path.
    """
    if on_absolute not in ("null", "keep"):
        raise ValueError("on_absolute must be 'null' or 'keep'")
    base = F.lit(root.rstrip("/"))
    parts = [base, image] if folder is None else [base, folder, F.lit("images"), image]
    # concat, unlike concat_ws, is NULL as soon as one part is NULL.
    slashed = [p for part in parts for p in (F.lit("/"), part)][1:]
    escaped = image.startswith("/")
    absolute = image if on_absolute == "keep" else F.lit(None).cast("string")
    return F.when(escaped, absolute).otherwise(F.concat(*slashed))


def text_or_nan(text: Column, missing_text: str = "nan") -> Column:
    """Missing text as the word ``nan`` or as the empty string."""
    if missing_text not in ("nan", "empty"):
        raise ValueError("missing_text must be 'nan' or 'empty'")
    return F.coalesce(text, F.lit("nan" if missing_text == "nan" else ""))


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex digest of seed and parts: the same for any partitioning of the rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def seeded_uniform(seed: int, *parts: Column) -> Column:
    """Number in [0, 1) from the first 32 bits of ``seeded_hash``."""
    head = F.substring(seeded_hash(seed, *parts), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(2**32))
