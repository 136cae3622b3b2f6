"""Table references of a SQL statement, with built-in expressions only.

Supported grammar: names after FROM, any word ending in JOIN, INTO, a bare INSERT or
TRUNCATE, UPDATE, TABLE, COPY; ``schema.table``, back-quoted names, aliases with or without AS,
comma lists (not after INTO), also behind sub-selects, ON and USING clauses, nested to any depth.
Literals and comments are removed first. A keyword in the place of a name, or anything
unreadable, gives no reference; the result is then an empty array.

Statements without parentheses and join conditions are read by one pattern. All others are cut
into tokens and folded: what a level of parentheses is waiting for is one character, so the state
is a short string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that cannot be an unquoted table name or alias.
RESERVED = (
    "add", "all", "alter", "and", "as", "asc", "between", "by", "case", "change", "check",
    "column", "constraint", "create", "cross", "delete", "desc", "distinct", "drop", "else",
    "end", "except", "exists", "for", "force", "foreign", "from", "full", "group", "having",
    "ignore", "in", "index", "inner", "insert", "intersect", "into", "is", "join", "key",
    "left", "like", "limit", "lock", "modify", "natural", "not", "null", "on", "or",
    "order", "outer", "partition", "primary", "procedure", "rename", "replace", "returning",
    "right", "select", "set", "straight_join", "table", "then", "to", "union", "unique",
    "update", "use", "using", "value", "values", "when", "where", "window", "with", "write",
    "read")

# A bare name may begin with digits but holds a letter, ``_`` or ``$``.
_BARE = r"\p{N}*[\p{L}_$][\p{L}\p{N}_$]*"
_QUOTED = r"`(?:[^`]|``)+`"
_WORD = r"(?:" + _QUOTED + r"|(?!(?:" + "|".join(RESERVED) + r")\b)" + _BARE + r")"
_NAME = _WORD + r"(?:\s*\.\s*(?:" + _QUOTED + "|" + _BARE + r"))?"
_REF = _NAME + r"(?:\s+(?:as\s+)?" + _WORD + r")?"
_MODIFIERS = r"(?:(?:low_priority|high_priority|delayed|quick|ignore|only|if\s+not\s+exists|if\s+exists)\s+)*"
_VERBS = r"(?:from|[a-z_]*join|update|table|copy|truncate(?!\s+table\b))"
_INTO = r"(?:into(?:\s+table)?|insert(?:\s+(?:low_priority|high_priority|delayed|ignore))*(?!\s+into\b))"
_LEAD = r"(?:" + _VERBS + "|" + _INTO + r")\s+" + _MODIFIERS
_LISTED = (r"(?i)\b(?:" + _INTO + r"\s+" + _MODIFIERS + _REF
           + r"|" + _VERBS + r"\s+" + _MODIFIERS
           + _REF + r"(?:\s*,\s*" + _REF + r")*)")
_PIECE = r"(" + _QUOTED + r"|[\p{L}\p{N}_$]+)"
_PARTS = r"(?i)^(?:" + _PIECE + r"\s*\.\s*)?" + _PIECE + r"(?:\s+(?:as\s+)?" + _PIECE + r")?$"

_COMMENTS = r"(?s)/\*.*?\*/|(?m:--[ \t].*$)|(?m:--$)|(?m:#.*$)"
_LITERALS = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\""
_NO_TABLE = (r"(?i)\bon\s+duplicate\s+key\s+update\b|\bfor\s+update\b|"
             r"\b(?:extract|trim|substring|substr|overlay)\s*\([^()]*\)")


def clean_statement(sql: Column) -> Column:
    """The statement without literals, comments and clauses that look like references. Plain
    searches decide first whether a pattern has anything to replace."""
    marks = ("'", '"', "#", "--", "/*")
    suspect = reduce(lambda a, b: a | b, (sql.contains(m) for m in marks))
    text = F.when(suspect, F.regexp_replace(sql, f"{_LITERALS}|{_COMMENTS}", " ? ")
                  ).otherwise(sql)
    return F.when(F.lower(text).rlike(r"(?:for|key)\s+update|[gmrty]\s*\("),
                  F.regexp_replace(text, _NO_TABLE, " ? ")).otherwise(text)


#: Words between a verb and its table, and words that end a list of tables.
_SKIPPED = ("low_priority", "high_priority", "delayed", "quick", "ignore", "only", "if", "not", "exists", "lateral")
_ENDERS = ("where", "group", "order", "having", "limit", "union", "set", "values", "value", "select", "window",
           "returning", "lock", "except", "intersect", "procedure")
_TOKENS = r"(?:" + _QUOTED + r"|[\p{L}\p{N}_$]+)(?:\s*\.\s*(?:" + _QUOTED + r"|[\p{L}\p{N}_$]+))?|\S"

# What a level waits for: nothing; a table of a list; what follows one; the end of a join
# condition; the one table of INTO; what follows that.
_NOTHING, _LIST, _LISTED_ONE, _CONDITION, _ONE, _DONE = "0", "1", "2", "3", "5", "6"


def _fold(tokens: Column) -> Column:
    """References (name and alias in one text) of a statement's tokens, in order."""
    def step(state: Column, token: Column) -> Column:
        levels, refs, fresh = state["levels"], state["refs"], state["fresh"]
        word, top = F.lower(token), F.right(levels, F.lit(1))
        below = F.left(levels, F.length(levels) - 1)
        verb = word.isin("from", "update", "table", "copy", "truncate") | word.rlike("^[a-z_]*join$")
        into, skipped = word.isin("into", "insert"), word.isin(*_SKIPPED)
        name = token.rlike(r"^(?:`|\p{N}*[\p{L}_$])") & ~word.isin(*RESERVED) & ~verb & ~into
        waits = top.isin(_LIST, _ONE)
        taken = waits & name & ~skipped
        alias = fresh & top.isin(_LISTED_ONE, _DONE) & name
        after = F.when(top == _LIST, _LISTED_ONE).when(top == _ONE, _DONE).otherwise(top)
        now = (F.when(taken, after).when(waits & skipped, top)
               .when(verb, _LIST).when(into, _ONE)
               .when((token == ",") & top.isin(_LISTED_ONE, _CONDITION), _LIST)
               .when(top.isin(_LISTED_ONE, _CONDITION) & word.isin("on", "using"), _CONDITION)
               .when(word.isin(*_ENDERS) | (waits & (token != ",")), _NOTHING).otherwise(top))
        return F.struct(
            F.when(token == "(", F.concat(below, after, F.when(top == _LIST, _LIST).otherwise(_NOTHING)))
            .when(token == ")", F.when(F.length(levels) > 1, below).otherwise(_NOTHING))
            .otherwise(F.concat(below, now)).alias("levels"),
            F.when(taken, F.concat(refs, F.array(token)))
            .when(alias, F.concat(F.slice(refs, 1, F.size(refs) - 1), F.array(
                F.concat(F.element_at(refs, -1), F.lit(" "), token)))).otherwise(refs).alias("refs"),
            (taken | (fresh & (word == "as"))).alias("fresh"))
    start = F.struct(F.lit(_NOTHING).alias("levels"), F.array().cast("array<string>").alias("refs"),
                     F.lit(False).alias("fresh"))
    return F.aggregate(tokens, start, step, lambda state: state["refs"])


def extract_tables(sql: Column) -> Column:
    """``ARRAY<STRUCT<schema, table, alias>>`` in order of appearance."""
    text = clean_statement(F.coalesce(sql, F.lit("")))
    nested = text.contains(",") & (text.contains("(") | F.lower(text).rlike(r"\b(?:on|using)\b"))
    clauses = F.regexp_extract_all(text, F.lit(_LISTED), 0)
    plain = F.flatten(F.transform(clauses, lambda x: F.split(
        F.regexp_replace(x, "(?i)^" + _LEAD, ""), ",")))
    refs = F.when(nested, _fold(F.regexp_extract_all(text, F.lit(_TOKENS), 0))).otherwise(plain)
    parts = F.transform(refs, lambda r: F.split(
        F.replace(F.replace(F.replace(
            F.regexp_replace(F.btrim(r), _PARTS, "$1\u0001$2\u0001$3"),
            F.lit("``"), F.lit("\u0002")), F.lit("`"), F.lit("")), F.lit("\u0002"), F.lit("`")),
        "\u0001"))

    def part(p: Column, i: int) -> Column:
        return F.when(p[i] != "", p[i])
    return F.transform(parts, lambda p: F.struct(
        part(p, 0).alias("schema"), part(p, 1).alias("table"), part(p, 2).alias("alias")))


def first_table(sql: Column) -> Column:
    """Name of the first referenced table, NULL when there is none."""
    return F.try_element_at(extract_tables(sql), F.lit(1))["table"]
