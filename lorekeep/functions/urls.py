"""Links to documents and to the form for a new one."""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a relative reference may hold; no colon in its first segment.
RELATIVE_REFERENCE = r"^(?:[A-Za-z0-9._~!$&'()*+,;=@-]|%[0-9A-Fa-f]{2})*(?:[/?](?:[A-Za-z0-9._~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*)?(?:#(?:[A-Za-z0-9._~!$&'()*+,;=:@/?-]|%[0-9A-Fa-f]{2})*)?$"


def document_url(base: str, file_name: Column) -> Column:
    """The name without its extension, resolved against the base URL.

    A base that does not end in a slash loses its last segment.  A name that is
    no relative reference links to the base itself.
    """
    name = F.regexp_replace(file_name, r"\.[^./]*$", "")
    resolved = (
        F.when(name == "", F.lit(base))
        .when(name.startswith("/"), F.concat(F.lit(urljoin(base, "/")), F.substr(name, F.lit(2))))
        .otherwise(F.concat(F.lit(urljoin(base, ".")), name))
    )
    return F.when(name.rlike(RELATIVE_REFERENCE), resolved).otherwise(F.lit(base))


def encode_query_value(text: Column) -> Column:
    """Percent-encode all but letters, digits and ``-._~``."""
    encoded = F.url_encode(text)
    for written, wanted in [("+", "%20"), ("*", "%2A"), ("%7E", "~")]:
        encoded = F.replace(encoded, F.lit(written), F.lit(wanted))
    return encoded


def new_page_url(base: str, query: Column) -> Column:
    """Link to a new document that starts with the query as its text."""
    return F.concat(F.lit(urljoin(base, "_new") + "?wiki%5Bbody%5D="), encode_query_value(query))
