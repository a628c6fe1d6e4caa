"""Guarded read-only SQL over registered views.

The text is held against forbidden words first. What decides is the statement as Spark parses it: every node of the parsed plan, every
expression and every function has to be on a list of what queries are made of; whatever else Spark's SQL can say, now or later
(commands, writes, scripts, files, table functions, names made at run time, calls of Java methods), is on none and is refused.
A relation must be a temporary view of the session or a name that the statement itself defines. Nothing runs before
that, and no setting of the session is touched: double quotes are turned to back ticks in the text.
"""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that must not occur.
FORBIDDEN = "DROP DELETE INSERT UPDATE ALTER CREATE TRUNCATE EXEC EXECUTE GRANT REVOKE COPY EXPORT IMPORT ATTACH".split()

# Functions that call what is outside the query: refused by their names alone, before the statement is parsed.
OUTSIDE = ("reflect", "java_method", "try_reflect")

# What a query is made of: nodes of a parsed plan, expressions, and functions.
NODES = frozenset(
    """Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join SubqueryAlias UnresolvedRelation UnresolvedWith
    UnresolvedHaving UnresolvedSubqueryColumnAliases WithWindowDefinition UnresolvedInlineTable OneRowRelation LocalRelation UnresolvedHint""".split()
)
EXPRESSIONS = frozenset(
    """Alias MultiAlias AttributeReference UnresolvedAlias UnresolvedAttribute UnresolvedStar UnresolvedFunction UnresolvedExtractValue UnresolvedNamedLambdaVariable LambdaFunction
    Literal Cast EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual And Or Not In InSubquery Exists ScalarSubquery ListQuery
    IsNull IsNotNull IsTrue IsFalse IsNotTrue IsNotFalse IsUnknown IsNotUnknown Like LikeAll LikeAny NotLikeAll NotLikeAny ILike RLike CaseWhen If Between Add Subtract Multiply Divide
    IntegralDivide Remainder UnaryMinus UnaryPositive Concat CreateNamedStruct CreateStruct SortOrder WindowExpression WindowSpecDefinition UnresolvedWindowExpression
    WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame CurrentRow UnboundedPreceding UnboundedFollowing GroupingSets Cube Rollup CurrentDate
    CurrentTimestamp Extract Substring StringTrim StringTrimLeft StringTrimRight StringLocate Overlay TimestampDiff TimestampAdd UnresolvedOrdinal""".split()
)
FUNCTIONS = frozenset(
    """abs any_value approx_count_distinct approx_percentile array array_agg array_contains array_distinct array_join array_max array_min array_position
    array_size array_sort avg between boolean cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains count count_if
    current_date date date_add date_diff date_format date_sub date_trunc day dayofmonth dayofweek decimal dense_rank double element_at endswith exists exp
    explode extract filter first first_value floor forall format_number format_string greatest grouping hour if in int isnotnull isnull lag last
    last_value lead least left len length levenshtein ln log log10 log2 lower lpad ltrim max max_by mean median min min_by minute mod mode month
    named_struct nth_value ntile nullif nvl percent_rank percentile percentile_cont percentile_disc pmod position pow power quarter rank regexp_extract
    regexp_extract_all regexp_like regexp_replace repeat replace reverse right round row_number rpad rtrim second sequence signum size slice sort_array
    split split_part sqrt startswith stddev stddev_samp string struct substr substring sum timestamp to_date to_timestamp transform translate trim trunc
    try_cast try_divide try_sum try_to_timestamp unix_timestamp upper var_samp variance weekday year""".split()
)

_LITERALS = re.compile(r"'(?:[^'\\]|\\.|'')*'")
_PIECES = re.compile(r"""('(?:[^'\\]|\\.|'')*'|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/)|"((?:[^"]|"")*)\"""", re.S)


class Refused(ValueError):
    """The text is not a query that may run."""


def check(sql: str, strict: bool = False) -> str:
    """The statement without its closing semicolon; Refused if its words say that it may not run. strict also refuses WITH and
    forbidden words inside literals. run_sql looks at the parsed plan as well."""
    text = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)select\b" if strict else r"(?i)(select|with)\b", text):
        raise Refused("a query begins with SELECT")
    looked = text if strict else _LITERALS.sub("''", text)
    hit = re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", looked)
    if hit:
        raise Refused(f"the word {hit[0]} is not allowed")
    hit = re.search(rf"(?i)\b({'|'.join(OUTSIDE)})\b`?\s*\(", looked)
    if hit:
        raise Refused(f"the function {hit[1]} is not allowed")
    return text


def with_back_ticks(sql: str) -> str:
    """Names in double quotes as names in back ticks; literals, comments and back ticks stay."""
    return _PIECES.sub(lambda m: m[1] if m[1] is not None else "`" + m[2].replace('""', '"').replace("`", "``") + "`", sql)


def _items(seq):
    """What a collection of the JVM holds."""
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def _kind(thing) -> str:
    return thing.getClass().getSimpleName().rstrip("$")


def check_plan(spark: SparkSession, text: str) -> None:
    """Refused if the parsed statement is made of anything but what is listed, or reads anything but views and names of its own."""
    state = spark._jsparkSession.sessionState()
    try:
        plan = state.sqlParser().parsePlan(text)
    except ParseException as error:
        raise Refused(f"the text can't be read: {error}") from None
    _check_node(state, plan, frozenset())


def _check_node(state, node, own: frozenset) -> None:
    kind = _kind(node)
    if kind not in NODES:
        raise Refused(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = list(_items(node.multipartIdentifier()))
        if len(parts) != 1 or not (parts[0].lower() in own or state.catalog().getTempView(parts[0]).isDefined()):
            raise Refused("only registered views are read")
    if kind == "UnresolvedWith":
        for one in _items(node.cteRelations()):
            name, query = one._1(), one._2()
            _check_node(state, query, own)  # a name is known to those after it
            own = own | {name.lower()}
    if kind == "WithWindowDefinition":
        for spec in _items(node.windowDefinitions().values()):
            _check_expression(state, spec, own)
    for expression in _items(node.expressions()):
        _check_expression(state, expression, own)
    for child in _items(node.children()):
        _check_node(state, child, own)


def _check_expression(state, expression, own: frozenset) -> None:
    kind = _kind(expression)
    if kind not in EXPRESSIONS:
        raise Refused(f"{kind} is not allowed")
    if kind == "UnresolvedFunction":
        parts = list(_items(expression.nameParts()))
        if len(parts) != 1 or parts[0].lower() not in FUNCTIONS:
            raise Refused(f"the function {'.'.join(parts)} is not allowed")
    if kind in ("Exists", "ScalarSubquery", "ListQuery"):
        _check_node(state, expression.plan(), own)
    if kind == "InSubquery":
        _check_expression(state, expression.query(), own)
    for child in _items(expression.children()):
        _check_expression(state, child, own)


def run_sql(spark: SparkSession, sql: str, strict: bool = False, quoted_identifiers: bool = True) -> DataFrame:
    """The rows of a query that passes the guard. Double quotes name columns, as in the dialect that queries come in."""
    text = check(sql, strict)
    if quoted_identifiers:
        text = with_back_ticks(text)
    check_plan(spark, text)
    return spark.sql(text)


def answered(spark: SparkSession, question: str, plan, strict: bool = False) -> tuple[DataFrame | None, str]:
    """Ask plan(question, problem) for SQL and run it; asked once more if it failed, gave no rows or one row of nulls."""
    problem, df = "", None
    for _ in range(2):
        try:
            sql = plan(question, problem)
            df = run_sql(spark, sql, strict)
            head = df.limit(2).collect()
        except Exception as error:  # noqa: BLE001  the planner gets to see any failure
            problem, df = str(error), None
            continue
        if head and not (len(head) == 1 and all(v is None for v in head[0])):
            return df, ""
        problem = "no rows" if not head else "a single row of nulls"
    return df, problem


def formatted(df: DataFrame, most: int = 100) -> tuple[list[str], str]:
    """(lines of `name=value`, markdown table) of the first rows of a report; numbers rounded to ten places, nulls left out of lines."""
    shown = df.limit(most + 1).select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]).collect()
    lines = [", ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in shown[:most]]
    return lines, markdown(df.columns, [["" if v is None else str(v) for v in r] for r in shown[:most]])


def markdown(headers: list[str], rows: list[list[str]]) -> str:
    """A markdown table; line ends and bars escaped, rows padded or cut to the header."""
    clean = lambda v: str(v).replace("\n", "<br>").replace("|", "&#124;")
    n = len(headers)
    body = [[clean(v) for v in [*r, *[""] * n][:n]] for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in [[clean(h) for h in headers], ["---"] * n, *body])
