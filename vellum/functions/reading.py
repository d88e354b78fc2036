"""Column builders that read dirty labels and hashes the way TESTDATA.md defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points taken as white space, in order.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def read_label(c: Column | str) -> Column:
    """Outer blanks stripped, lower case, ``-`` as ``_``; NULL if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.translate(F.lower(F.btrim(c, F.lit(BLANKS))), "-", "_")
    return F.when(F.length(text) > 0, text)


def read_phash(c: Column | str) -> Column:
    """The 64 bits as a signed BIGINT; NULL unless exactly 16 hex digits, not all zero, remain."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.translate(F.lower(c), BLANKS + "-:", "")
    text = F.when(text.startswith("0x"), F.substring(text, 3, 1 << 30)).otherwise(text)
    good = text.rlike("^[0-9a-f]{16}$") & (text != "0" * 16)
    return F.when(good, F.conv(text, 16, -10).cast("bigint"))


def read_sha256(c: Column | str) -> Column:
    """The digest in lower case; NULL unless 64 characters remain that aren't the empty content's digest."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.lower(F.btrim(c, F.lit(BLANKS)))
    text = F.when(text.startswith("sha256:"), F.btrim(F.substring(text, 8, 1 << 30), F.lit(BLANKS))).otherwise(text)
    return F.when((F.length(text) == 64) & (text != EMPTY_SHA256), text)
