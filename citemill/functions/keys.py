"""Keys that file paths and DOIs carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes (lower case) and the languages that they stand for.
LANGUAGES = {".r": "R", ".rscript": "R", ".py": "Python", ".ipynb": "Python", ".do": "Stata"}
# Which suffixes count as scripts, by who asks.
EXTENSIONS = {
    "analysis": (".R", ".r", ".Rscript", ".py", ".ipynb", ".do"),
    "collection": (".R", ".py", ".do", ".Rscript", ".ipynb"),
    "boxes": (".r", ".py", ".do", ".ipynb", ".m", ".sas"),
    "archives": (".r", ".py", ".do", ".ipynb", ".jl", ".m", ".sas"),
}


def suffix(path: Column) -> Column:
    """From the last dot of the file name on; names that start with their only dot have none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language(path: Column) -> Column:
    ext = F.lower(suffix(path))
    out = F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def has_suffix(path: Column, kind: str = "analysis", case_sensitive: bool = True) -> Column:
    some = EXTENSIONS[kind]
    return suffix(path).isin(*some) if case_sensitive else F.lower(suffix(path)).isin(*{e.lower() for e in some})


def ends_with_any(name: Column, some: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(e) for e in some)), lambda e: F.endswith(name, e))


def _part(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def source(path: Column, compat: bool = False) -> Column:
    """Which source a script comes from. compat: only the layouts with a listing folder, and the two that the path names."""
    listed = _part(path, r"/([^/]+)_datasets_files/")
    named = F.when(F.contains(path, F.lit("icpsr")), "icpsr").when(F.contains(path, F.lit("zenodo")), "zenodo")
    if compat:
        return F.coalesce(named, listed)
    return F.coalesce(
        named, listed, F.when(path.rlike(r"(^|/)ResearchBox_\d+/"), "researchbox"), F.when(path.rlike(r"(^|/)osf/[^/]+/"), "osf"), F.when(path.rlike(r"(^|/)dataverse/[^/]+/"), "dataverse"),
    )


def repo_id(path: Column, compat: bool = False) -> Column:
    """Which repository. compat: null for the two sources that the path names, as those rows leave the tally."""
    listed = _part(path, r"_datasets_files/([^/]+)/")
    icpsr, zenodo = F.contains(path, F.lit("icpsr")), F.contains(path, F.lit("zenodo"))
    if compat:
        return F.when(icpsr | zenodo, F.lit(None).cast("string")).otherwise(listed)
    return (
        F.when(icpsr, _part(path, r"icpsr/([^/]+)/")).when(zenodo, _part(path, r"zenodo/([^/]+)/"))
        .otherwise(F.coalesce(listed, _part(path, r"(?:^|/)ResearchBox_(\d+)/"), _part(path, r"(?:^|/)osf/([^/]+)/"), _part(path, r"(?:^|/)dataverse/([^/]+)/")))
    )


def normal_doi(doi: Column) -> Column:
    return F.replace(doi, F.lit("https://doi.org/"), F.lit("doi:"))


def bare_doi(doi: Column) -> Column:
    """Without either resolver's address."""
    return F.replace(F.replace(doi, F.lit("https://doi.org/"), F.lit("")), F.lit("http://dx.doi.org/"), F.lit(""))


def doi_tail(doi: Column) -> Column:
    return F.element_at(F.split(doi, "/"), -1)


def padded_id(value: Column, width: int = 5) -> Column:
    """Zeros in front up to the width; longer ids stay as they are."""
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
