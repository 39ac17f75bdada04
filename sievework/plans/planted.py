"""Whole texts of the documents with passages set into them, by SQL that both engines read; what the rules say of a text, each engine works out itself."""

from __future__ import annotations


def quoted(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def planted(passages: tuple[str, ...], gap: str = "\n", *, table: str = "documents", key: str = "doc_id", text: str = "text", more: str = "", before: str = "") -> str:
    """SELECT (k, text, w): each row's whole text with one passage at a place that its id gives, and every second one with another at its end.

    A row each of the table; every fifth is left as it is. {w} in a passage is the word `w` that the id spells. With `before`, a passage stands before the next such mark.
    `more` are further columns, as `, column`.
    """
    values, n = ", ".join(f"({i}, {quoted(p)})" for i, p in enumerate(passages)), len(passages)
    word = f"concat('Zor', translate(CAST({key} AS STRING), '0123456789', 'abcdefghij'))"
    at = f"cut + greatest(instr(substring(t, cut + 1, 10000000), {quoted(before)}), 1) - 1" if before else "cut"
    return f"""SELECT k, CASE WHEN k % 5 = 4 THEN t ELSE concat(substring(t, 1, {at}), '{gap}', replace(a.p, '{{w}}', w), '{gap}', substring(t, {at} + 1, 10000000),
        CASE WHEN k % 2 = 0 THEN concat('{gap}', replace(b.p, '{{w}}', w)) ELSE '' END) END AS text, w{more}
    FROM (SELECT {key} AS k, coalesce({text}, '') AS t, {word} AS w{more}, CAST(({key} * 7919 + 13) % (length(coalesce({text}, '')) + 1) AS INT) AS cut,
        CAST({key} % {n} AS INT) AS i, CAST(floor({key} / {n}) AS BIGINT) % {n} AS j FROM {table}) d
    JOIN (VALUES {values}) a(i, p) ON d.i = a.i JOIN (VALUES {values}) b(j, p) ON d.j = b.j"""
