"""Column functions that turn extracted text into typed notice fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderlake.functions.text import present

# Spellings of the tender modality and their codes.
MODALITIES = {
    "pp": 0,
    "pregão presencial": 0,
    "pe": 1,
    "pregão eletrônico": 1,
    "concorrência": 2,
    "concorrência pública": 2,
    "cp": 2,
    "convite": 3,
    "concurso": 4,
    "leilão": 5,
    "tomada de preço": 6,
    "tomada de preços": 6,
    "convênio": 7,
}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def modality_code(col: Column) -> Column:
    return F.try_element_at(literal_map(MODALITIES), F.lower(col)).cast("int")


def notice_date(col: Column) -> Column:
    """``d/m/yyyy`` or ``d-m-yyyy`` to that day at 03:00; anything else is NULL."""
    parts = F.split(col, F.when(col.contains("/"), "/").otherwise("-"))
    day, month, year = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    well_formed = (
        (F.size(parts) == 3)
        & year.rlike(r"^\s*[0-9]{4}\s*\z")
        & month.rlike(r"^\s*[0-9]{1,2}\s*\z")
        & day.rlike(r"^\s*[0-9]{1,2}\s*\z")
    )
    number = [F.btrim(p).try_cast("int") for p in (year, month, day)]
    stamp = F.try_make_timestamp_ntz(*number, F.lit(3), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(well_formed, stamp)


def date_text(col: Column) -> Column:
    return F.date_format(col, "dd/MM/yyyy")


def item_hash(number: Column, agency: Column, modality: Column, link: Column) -> Column:
    """Identity of a list item: of its three key texts joined bare, else of its link, else empty."""
    return (
        F.when(
            present(number) & present(agency) & present(modality),
            F.md5(F.concat(number, agency, modality)),
        )
        .when(present(link), F.md5(link))
        .otherwise("")
    )
