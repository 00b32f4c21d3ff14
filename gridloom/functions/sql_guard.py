"""Read-only check of SQL texts, as a column expression and for one text."""

from __future__ import annotations

import re
from contextlib import contextmanager

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Words that make a statement mutating, and the words a query may start with.
BLOCKED_WORDS = (
    "insert", "update", "delete", "create", "drop", "alter", "copy",
    "attach", "detach", "install", "load", "call", "pragma",
)
ALLOWED_FIRST_WORDS = ("select", "with")

_BLOCKED = r"\b(" + "|".join(BLOCKED_WORDS) + r")\b"
_ALLOWED = r"^(" + "|".join(ALLOWED_FIRST_WORDS) + r")(\s|$)"


class GuardError(ValueError):
    """A refused request; ``code`` is the stable error code."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def sql_verdict(sql: Column) -> Column:
    """``ok``, ``empty_sql``, ``mutating_sql_rejected`` or ``unsupported_sql`` per text."""
    body = F.regexp_replace(F.regexp_replace(sql, r"(?U)^\s+|\s+$", ""), r";+$", "")
    return (
        F.when(F.coalesce(body, F.lit("")) == "", F.lit("empty_sql"))
        .when(body.rlike("(?iU)" + _BLOCKED), F.lit("mutating_sql_rejected"))
        .when(~F.ltrim(body).rlike("(?iU)" + _ALLOWED), F.lit("unsupported_sql"))
        .otherwise(F.lit("ok"))
    )


# The nodes of Spark's parsed plan that a query over region tables can be made of, below ``catalyst``.
PLAN_NODES = frozenset((
    "analysis.UnresolvedHaving", "analysis.UnresolvedInlineTable", "analysis.UnresolvedRelation", "analysis.UnresolvedSubqueryColumnAliases",
    "analysis.UnresolvedTableValuedFunction", "plans.logical.Aggregate", "plans.logical.Deduplicate", "plans.logical.Distinct", "plans.logical.Except",
    "plans.logical.Filter", "plans.logical.Generate", "plans.logical.GlobalLimit", "plans.logical.Intersect", "plans.logical.Join",
    "plans.logical.LateralJoin", "plans.logical.LocalLimit", "plans.logical.LocalRelation", "plans.logical.Offset", "plans.logical.OneRowRelation",
    "plans.logical.Pivot", "plans.logical.Project", "plans.logical.RepartitionByExpression", "plans.logical.Sample", "plans.logical.Sort",
    "plans.logical.SubqueryAlias", "plans.logical.Union", "plans.logical.UnresolvedHint", "plans.logical.UnresolvedWith", "plans.logical.Unpivot",
    "plans.logical.WithWindowDefinition",
))
# Expressions that the parser leaves open for the analyser.
OPEN_EXPRESSIONS = frozenset((
    "UnresolvedAlias", "UnresolvedAttribute", "UnresolvedExtractValue", "UnresolvedFunction", "UnresolvedGenerator", "UnresolvedOrdinal", "UnresolvedRegex",
    "UnresolvedStar", "UnresolvedStarExceptOrReplace", "MultiAlias",
))
# Groups of built-in functions that compute on their arguments alone, and functions of other groups that do.
FUNCTION_GROUPS = frozenset((
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs",
    "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs",
    "url_funcs", "variant_funcs", "window_funcs", "xml_funcs",
))
OTHER_FUNCTIONS = frozenset(("typeof", "bitmap_bit_position", "bitmap_bucket_number", "bitmap_count", "hll_sketch_estimate", "hll_union"))
TABLE_FUNCTIONS = frozenset(("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple"))

_CATALYST = "org.apache.spark.sql.catalyst."


class ParsedQuery:
    """What Spark's own parser makes of a text. ``relations``: tables it names that are no common tables of its own."""

    def __init__(self, spark: SparkSession, sql: str):
        self._gateway = spark.sparkContext._gateway
        self._registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self._named = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.relations: set[str] = set()
        # Nothing is analysed or run here.
        self._walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))

    def _is(self, thing, name: str) -> bool:
        return is_instance_of(self._gateway, thing, name)

    def _walk(self, root) -> None:
        """Every field of every node: subqueries, named windows and hints included. A common table is known where it is in scope."""
        waiting: list[tuple] = [(root, frozenset())]
        while waiting:
            thing, known = waiting.pop()
            if not isinstance(thing, JavaObject):
                continue
            if self._is(thing, _CATALYST + "trees.TreeNode"):
                self._check(thing, known)
                if thing.getClass().getName() == _CATALYST + "plans.logical.UnresolvedWith":
                    tables = thing.cteRelations().iterator()
                    while tables.hasNext():
                        table = tables.next()
                        name = frozenset((table.productElement(0).lower(),))
                        waiting.append((table.productElement(1), known | name if thing.allowRecursion() else known))
                        known |= name
                    waiting.append((thing.child(), known))
                    continue
                fields = thing.productIterator()
            elif self._is(thing, "scala.collection.Iterable"):
                fields = thing.iterator()
            elif self._is(thing, "scala.Product"):
                fields = thing.productIterator()
            else:
                continue
            while fields.hasNext():
                waiting.append((fields.next(), known))

    def _check(self, node, known: frozenset[str]) -> None:
        name = node.getClass().getName().removeprefix(_CATALYST).rstrip("$")
        short = name.rsplit(".", 1)[-1]
        if self._is(node, _CATALYST + "plans.logical.LogicalPlan"):
            if name not in PLAN_NODES:
                raise _refused(f"{short} is not part of a read-only query")
            if short == "UnresolvedRelation":
                table = self._one_part(node.multipartIdentifier(), "tables are named in one part").lower()
                if table not in known:
                    self.relations.add(table)
            elif short == "UnresolvedTableValuedFunction":
                function = self._one_part(node.name(), "functions are named in one part")
                if function.lower() not in TABLE_FUNCTIONS:
                    raise _refused(f"the table function {function} is not allowed")
        elif name.startswith("analysis."):
            if short not in OPEN_EXPRESSIONS:
                raise _refused(f"{short} is not allowed")
            if short == "UnresolvedFunction":
                self._function(self._one_part(node.nameParts(), "functions are named in one part"))
            elif short == "UnresolvedGenerator":
                self._function(node.name().funcName())
        elif not name.startswith("expressions.") or short in ("CallMethodViaReflection", "TryReflect"):
            raise _refused(f"{short} is not allowed")

    @staticmethod
    def _one_part(parts, message: str) -> str:
        if parts.size() != 1:
            raise _refused(message)
        return parts.head()

    def _function(self, name: str) -> None:
        if name.lower() in OTHER_FUNCTIONS:
            return
        known = self._registry.lookupFunction(self._named(name.lower()))
        if known.isDefined() and known.get().getGroup() not in FUNCTION_GROUPS:
            raise _refused(f"the function {name} is not allowed")
        # A name that is no built-in function would be one the session was given.
        if not known.isDefined():
            raise GuardError("unknown_function", f"there is no built-in function {name}")


def _refused(message: str) -> GuardError:
    return GuardError("mutating_sql_rejected", message)


def parsed_read_only(sql: str, spark: SparkSession | None = None) -> tuple[str, ParsedQuery]:
    """The text without final semicolons and its parsed plan; GuardError unless it is a read-only query.

    The words of the text are checked first, then every node of the plan that Spark's parser makes of it: only what a query
    over tables needs is let through, by name. Script transforms, method calls, files named as tables, commands, variables
    and functions of the session have no way in, however a text is quoted or commented. A text that does not parse is
    Spark's ParseException.
    """
    body = sql.strip().rstrip(";").rstrip()
    if not body.strip():
        raise GuardError("empty_sql", "the query is empty")
    if re.search(_BLOCKED, body, re.IGNORECASE):
        raise GuardError("mutating_sql_rejected", "only read-only queries are allowed")
    if body.split(None, 1)[0].lower() not in ALLOWED_FIRST_WORDS:
        raise GuardError("unsupported_sql", "a query starts with SELECT or WITH")
    spark = spark or SparkSession.active()
    with double_quoted_names(spark):
        return body, ParsedQuery(spark, body)


def require_read_only(sql: str, spark: SparkSession | None = None) -> str:
    """Raise GuardError unless the text is a SELECT/WITH query; returns it without final semicolons."""
    return parsed_read_only(sql, spark)[0]


_QUOTED = "spark.sql.ansi.doubleQuotedIdentifiers"


@contextmanager
def double_quoted_names(spark: SparkSession):
    """Texts are read with double-quoted identifiers, by the guard as by the query."""
    before = spark.conf.get(_QUOTED)
    spark.conf.set(_QUOTED, "true")
    try:
        yield
    finally:
        spark.conf.set(_QUOTED, before)
