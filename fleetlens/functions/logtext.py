"""Column functions for decoded transaction-log text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the decoded-log format.
BEGIN_LINE = "BEGIN"
COMMIT_MARK = "COMMIT/*!*/;"
CHANGE_WORDS = ("UPDATE", "INSERT", "DELETE")
CHANGE_LINES = ("### UPDATE", "### INSERT INTO", "### DELETE FROM")
POSITION_LINE = "# at "

_BLANKS = " \t\r\n"
_STAMP = r"^#\d{6} +\d{1,2}:\d{2}:\d{2} server"


def is_begin(line: Column) -> Column:
    """The trimmed line is exactly BEGIN."""
    return line.contains(BEGIN_LINE) & (F.btrim(line, F.lit(_BLANKS)) == BEGIN_LINE)


def is_commit(line: Column, mode: str = "compat") -> Column:
    """The line holds the commit marker; ``strict`` does not take it from a row image."""
    found = line.contains(COMMIT_MARK)
    return found & ~is_row_text(line) if mode == "strict" else found


def is_row_text(line: Column) -> Column:
    """Lines that print row images; data values occur only here."""
    return line.startswith("###")


def is_change(line: Column, mode: str) -> Column:
    """A changed row. ``strict`` wants the statement line, ``compat`` the bare word."""
    words, test = ((CHANGE_LINES, line.startswith) if mode == "strict"
                   else (CHANGE_WORDS, line.contains))
    found = test(words[0])
    for word in words[1:]:
        found = found | test(word)
    return found


def as_bigint(text: Column) -> Column:
    """Digits to BIGINT, anything else to NULL. The pattern goes first because a failing
    try_cast builds an exception per row."""
    return F.when(text.rlike(r"^\d{1,19}$"), text.try_cast("bigint"))


def _number(line: Column, before: str) -> Column:
    """The number after the pattern ``before``; NULL for more than 19 digits. The text is searched
    once: a test of what was found would search it again in a branch."""
    return F.regexp_extract(line, before + r"(?:(\d{1,19})(?!\d)|\d)", 1).try_cast("bigint")


def log_ts(line: Column) -> Column:
    """Event-header time as TIMESTAMP_NTZ; NULL when the line has none.

    One-digit hours, padded with a blank or not, are accepted.
    """
    clock = F.ltrim(F.substring_index(F.substring(line, 8, 24), " server", 1))
    text = F.concat(F.lit("20"), F.substring(line, 2, 2), F.lit("-"), F.substring(line, 4, 2),
                    F.lit("-"), F.substring(line, 6, 2), F.lit(" "), clock)
    return F.when(line.rlike(_STAMP), text.try_cast("timestamp_ntz"))


def event_ts(line: Column) -> Column:
    """Time of an event header; NULL for all other lines, row images among them."""
    return F.when(line.startswith("#") & ~is_row_text(line), log_ts(line))


def end_log_pos(line: Column) -> Column:
    return _number(line, r"end_log_pos\s+")


def last_token(line: Column) -> Column:
    return F.substring_index(F.btrim(line, F.lit(_BLANKS)), " ", -1)


def number_after(line: Column, name: str) -> Column:
    """The number in ``name=<number>``."""
    return _number(line, name + "=")


def log_position(line: Column) -> Column:
    """N of a ``# at N`` line, else NULL."""
    return F.when(line.startswith(POSITION_LINE), _number(line, "^# at "))


def describe_transaction() -> Column:
    """Summary text of a transaction row."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
    return F.format_string(
        "transaction %s: %s rows, %s bytes, %s s, started %s, lines %s-%s, "
        "last_committed %s, sequence_number %s",
        shown("xid"), shown("n_rows"), shown("size"), shown("secs"),
        F.coalesce(F.date_format("start_time", "yyyy-MM-dd HH:mm:ss"), F.lit("unknown")),
        shown("start_line"), shown("end_line"), shown("last_committed"),
        shown("sequence_number"))
