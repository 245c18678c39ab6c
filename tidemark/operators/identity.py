"""Who is who: exact and loose signatures of commit authors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The id and name of an author that no entry matches.
UNMATCHED, UNMATCHED_NAME = (1 << 18) - 2, "<unmatched>"


def exact_key(name: Column, email: Column) -> Column:
    """One identity per lower-cased 'name <email>'."""
    return F.concat(F.lower(F.coalesce(name, F.lit(""))), F.lit(" <"), F.lower(F.coalesce(email, F.lit(""))), F.lit(">"))


def loose_ids(signatures: Iterable[tuple[str, str]]) -> dict[tuple[str, str], int]:
    """Ids of (name, email) signatures in order of first appearance.

    A known e-mail decides, then a known name; a signature that is known by either lends its other
    half to that identity. Two identities never merge later: the result depends on the order.
    """
    by_mail: dict[str, int] = {}
    by_name: dict[str, int] = {}
    out: dict[tuple[str, str], int] = {}
    for name, email in signatures:
        n, m = name.lower(), email.lower()
        who = by_mail.get(m) if m else None
        if who is None:
            who = by_name.get(n) if n else None
        if who is None:
            who = len(set(by_mail.values()) | set(by_name.values()))
        if m:
            by_mail.setdefault(m, who)
        if n:
            by_name.setdefault(n, who)
        out[name, email] = who
    return out


def people_dictionary(identified: DataFrame) -> DataFrame:
    """(person_id, display) of rows (person_id, name, email): names in order joined by '|', then e-mails."""
    grouped = identified.groupBy("person_id").agg(F.sort_array(F.collect_set(F.lower("name"))).alias("n"), F.sort_array(F.collect_set(F.lower("email"))).alias("e"))
    return grouped.select("person_id", F.concat_ws("|", F.concat_ws("|", "n"), F.concat_ws("|", "e")).alias("display"))
