"""Column expressions on file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmark.config import IMAGE_EXTENSIONS, NON_LABEL_FILES


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def extension(path: Column) -> Column:
    """Last extension with its dot, empty when there is none."""
    return F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def is_image(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    """Image by extension, whatever its case."""
    return F.lower(extension(path)).isin(*extensions)


def is_listed_image(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    """Image by extension in all-lower or all-upper case, as the audit looks for them."""
    return extension(path).isin(*extensions, *[e.upper() for e in extensions])


def is_label(path: Column) -> Column:
    """Text files that can hold annotations."""
    return (extension(path) == ".txt") & ~base_name(path).isin(*NON_LABEL_FILES)


def scan_rank(path: Column, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> Column:
    """Order in which images of one key are met: by extension, upper case last."""
    order = F.lit(None).cast("int")
    for place, ext in reversed(list(enumerate((*extensions, *[e.upper() for e in extensions])))):
        order = F.when(extension(path) == ext, place).otherwise(order)
    return order


def logical_stem(relative: Column) -> Column:
    """Pairing key of a path relative to the dataset root.

    A leading ``images/`` or ``labels/`` is dropped, and so is one in second
    place; the extension goes too. ``images/train/a.jpg``, ``labels/train/a.txt``
    and ``train/images/a.jpg`` share the key ``train/a``.
    """
    bare = F.regexp_replace(relative, r"^(?:images|labels)/", "")
    bare = F.regexp_replace(bare, r"^([^/]+)/(?:images|labels)/", "$1/")
    folder = F.regexp_extract(bare, r"^(.*/)[^/]*$", 1)
    return F.concat(folder, stem(bare))


def export_name(domain: Column, source: Column, path: Column) -> Column:
    """Name of a sample in a built dataset."""
    return F.concat(F.substring(domain, 1, 3), F.lit("_"), source, F.lit("_"), base_name(path))
