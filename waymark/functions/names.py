"""Names of documents and references to them, brought to one form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def undo_percent(s: Column) -> Column:
    """Percent-encoding decoded; a % that starts no escape stays, as does +."""
    safe = F.regexp_replace(F.regexp_replace(s, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(safe), s)


def reference_name(ref: Column) -> Column:
    """A reference without its ``|display`` and ``#heading`` parts, percent-decoded."""
    return undo_percent(F.regexp_replace(ref, r"(?s)[|#].*$", ""))


def is_ascii(s: Column) -> Column:
    return F.octet_length(s) == F.char_length(s)


def fold_ascii(s: Column) -> Column:
    """``fold`` for text of ASCII characters only, inside the JVM."""
    return F.lower(F.regexp_replace(s, r"^\s+|\s+$", ""))


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Blanks around it gone, composed letters (NFC), lower case."""
    form = lambda x: unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).lower()).strip()
    return s.map(form, na_action="ignore")
