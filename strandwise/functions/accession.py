"""Accessions: three letters and up to ten digits, also packed into a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(accession: Column) -> Column:
    """The accession as a number: letters in base 26, then digits, then 4 bits for the number of digits.

    Signs other than letters and digits are skipped. Null for anything but
    three letters and one to ten digits, and for the one that would pack to 0.
    """
    plain = F.regexp_replace(F.upper(accession), "[^A-Z0-9]", "")
    letters, digits = F.regexp_replace(plain, "[0-9]", ""), F.regexp_replace(plain, "[A-Z]", "")
    value = F.lit(0).cast("long")
    for i in range(3):
        value = value * 26 + (F.ascii(F.substring(letters, i + 1, 1)) - 65)
    number = value * F.pow(F.lit(10.0), F.length(digits)).cast("long") + digits.cast("long")
    packed = F.shiftleft(number, 4).bitwiseOR((F.length(digits) - 1).cast("long"))
    fits = plain.rlike("^[A-Z]{3}[0-9]{1,10}$")
    return F.when(fits, F.nullif(packed, F.lit(0).cast("long")))


def unpack(packed: Column) -> Column:
    digits = (packed.bitwiseAND(F.lit(15)) + 1).cast("int")
    data = F.shiftright(packed, 4)
    scale = F.pow(F.lit(10.0), digits).cast("long")
    # exact: the differences are multiples, and doubles hold numbers of this size
    head = ((data - data % scale) / scale).cast("long")
    letter = lambda n: F.char(n % 26 + 65)
    first, second, third = (head - head % 676) / 676, ((head - head % 26) / 26), head
    return F.concat(letter(first.cast("long")), letter(second.cast("long")), letter(third), F.lpad((data % scale).cast("string"), digits, "0"))


def from_path(path: Column) -> Column:
    """The last part of a path up to its first punctuation sign (its first character always counts)."""
    return F.regexp_extract(F.regexp_extract(path, r"([^/]+)/*$", 1), r"^.[^\p{Punct}]*", 0)
