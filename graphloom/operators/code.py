"""What the text of code tells: effects of calls, complexity, return values, parameters, naming.

Everything is a column expression or a plain aggregate, over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (mark, category, confidence); the first mark that a call holds, in any case, decides.
MARKS = [
    ("fs.writeFile", "io-file", "high"),
    ("fs.writeFileSync", "io-file", "high"),
    ("fs.readFile", "io-file", "high"),
    ("fs.readFileSync", "io-file", "high"),
    ("fs.appendFile", "io-file", "high"),
    ("fs.unlink", "io-file", "high"),
    ("fs.mkdir", "io-file", "high"),
    ("fs.rmdir", "io-file", "high"),
    ("fs.rename", "io-file", "high"),
    ("fs.copyFile", "io-file", "high"),
    ("fs.chmod", "io-file", "high"),
    ("fs.chown", "io-file", "high"),
    ("fs.createWriteStream", "io-file", "high"),
    ("fs.createReadStream", "io-file", "high"),
    ("writeJson", "io-file", "medium"),
    ("readJson", "io-file", "medium"),
    ("fetch", "io-network", "high"),
    ("axios", "io-network", "high"),
    ("axios.get", "io-network", "high"),
    ("axios.post", "io-network", "high"),
    ("axios.put", "io-network", "high"),
    ("axios.delete", "io-network", "high"),
    ("http.request", "io-network", "high"),
    ("https.request", "io-network", "high"),
    ("http.get", "io-network", "high"),
    ("https.get", "io-network", "high"),
    ("WebSocket", "io-network", "high"),
    ("socket.send", "io-network", "high"),
    ("socket.emit", "io-network", "high"),
    (".query", "io-database", "medium"),
    (".execute", "io-database", "medium"),
    (".save", "io-database", "high"),
    (".insert", "io-database", "high"),
    (".update", "io-database", "high"),
    (".delete", "io-database", "high"),
    (".remove", "io-database", "medium"),
    (".findOne", "io-database", "high"),
    (".findMany", "io-database", "high"),
    (".find", "io-database", "medium"),
    (".create", "io-database", "medium"),
    ("prisma.", "io-database", "high"),
    ("mongoose.", "io-database", "high"),
    ("sequelize.", "io-database", "high"),
    ("knex", "io-database", "high"),
    ("console.log", "io-console", "high"),
    ("console.error", "io-console", "high"),
    ("console.warn", "io-console", "high"),
    ("console.info", "io-console", "high"),
    ("console.debug", "io-console", "high"),
    ("console.trace", "io-console", "high"),
    ("console.table", "io-console", "high"),
    ("logger.", "io-console", "medium"),
    ("log.", "io-console", "low"),
    ("pino", "io-console", "medium"),
    ("winston", "io-console", "medium"),
    ("setTimeout", "async-spawn", "high"),
    ("setInterval", "async-spawn", "high"),
    ("setImmediate", "async-spawn", "high"),
    ("process.nextTick", "async-spawn", "high"),
    ("queueMicrotask", "async-spawn", "high"),
    ("requestAnimationFrame", "async-spawn", "high"),
    ("Worker", "async-spawn", "high"),
    ("child_process", "async-spawn", "high"),
    ("spawn", "async-spawn", "medium"),
    ("exec", "async-spawn", "medium"),
    ("fork", "async-spawn", "high"),
    ("sendEmail", "external-service", "high"),
    ("sendSMS", "external-service", "high"),
    ("sendNotification", "external-service", "high"),
    ("stripe.", "external-service", "high"),
    ("twilio.", "external-service", "high"),
    ("aws.", "external-service", "high"),
    ("s3.", "external-service", "high"),
    ("sqs.", "external-service", "high"),
    ("sns.", "external-service", "high"),
    ("firebase.", "external-service", "high"),
    ("analytics.", "external-service", "medium"),
    ("track", "external-service", "low"),
    ("document.", "dom-manipulation", "high"),
    ("window.", "dom-manipulation", "medium"),
    (".innerHTML", "dom-manipulation", "high"),
    (".innerText", "dom-manipulation", "high"),
    (".textContent", "dom-manipulation", "high"),
    (".appendChild", "dom-manipulation", "high"),
    (".removeChild", "dom-manipulation", "high"),
    (".setAttribute", "dom-manipulation", "high"),
    (".classList.", "dom-manipulation", "high"),
    (".style.", "dom-manipulation", "high"),
    ("localStorage.", "dom-manipulation", "high"),
    ("sessionStorage.", "dom-manipulation", "high"),
    (".emit", "event-emission", "medium"),
    (".dispatch", "event-emission", "medium"),
    ("dispatchEvent", "event-emission", "high"),
    (".trigger", "event-emission", "medium"),
    (".publish", "event-emission", "medium"),
    (".broadcast", "event-emission", "medium"),
]
#: Verbs that tell a category where no mark does.
VERBS = [
    (("write", "save", "store"), "io-file"),
    (("send", "post", "push"), "io-network"),
    (("delete", "remove", "destroy"), "io-database"),
]
#: Categories by risk.
SEVERE = ("io-database", "io-file", "external-service", "mutation-global")
MODERATE = ("io-network", "mutation-param", "mutation-this", "async-spawn")

#: Names of parameters that tell their purpose, first match first.
PURPOSES = [
    ("config", r"(?i)^(config|options|opts|settings|preferences|params|args)$"),
    ("config", r"Config$|Options$|Settings$"),
    ("callback", r"(?i)^(callback|cb|handler|listener|onSuccess|onError|onComplete|fn|func)$"),
    ("callback", r"^on[A-Z]|Callback$|Handler$"),
    ("context", r"(?i)^(ctx|context|req|request|res|response|session|this)$"),
    ("context", r"Context$"),
    ("input", r"(?i)^(data|input|value|item|element|record|entity|payload)$"),
    ("output", r"(?i)^(out|output|result|ref)$"),
]

#: Comments and strings, whichever begins first.
ASIDE = r"(?s)/\*.*?\*/|//[^\n]*|" + r'"[^"\n]*"' + r"|'[^'\n]*'|`[^`]*`"


def _holds(text: Column, marks) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def effect(call: Column) -> Column:
    """A call's struct of category and confidence; null if nothing tells one."""
    low = F.lower(call)
    known = F.array(*[F.struct(F.lit(m.lower()).alias("mark"), F.lit(c).alias("category"), F.lit(s).alias("confidence")) for m, c, s in MARKS])
    first = F.get(F.filter(known, lambda m: low.contains(m["mark"])), F.lit(0))
    told = lambda category, confidence: F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
    guess = F.when(low.contains("set") & _holds(low, ("this.", "self.")), told("mutation-this", "medium"))
    for verbs, category in VERBS:
        guess = guess.when(_holds(low, verbs), told(category, "low"))
    return F.when(first.isNotNull(), F.struct(first["category"].alias("category"), first["confidence"].alias("confidence"))).otherwise(guess)


def effect_risk(found: DataFrame, entity: str = "entity") -> DataFrame:
    """entity and level (high, medium, low) from its effects: category, conditional."""
    counted = found.groupBy(entity).agg(
        F.count_if(F.col("category").isin(*SEVERE)).alias("severe"),
        F.count_if(F.col("category").isin(*MODERATE)).alias("moderate"),
        F.count_if(~F.coalesce("conditional", F.lit(False))).alias("always"),
    )
    s, m, a = F.col("severe"), F.col("moderate"), F.col("always")
    high = (s >= 2) | ((s >= 1) & (a >= 2))
    medium = (s >= 1) | (m >= 2) | (a >= 3)
    return counted.select(entity, F.when(high, "high").when(medium, "medium").otherwise("low").alias("level"))


def plain(body: Column) -> Column:
    """Code without comments and strings."""
    return F.regexp_replace(F.regexp_replace(body, r"\\.", ""), ASIDE, "")


def complexity(body: Column) -> Column:
    """1 and one for each branch, loop, case, catch, conditional expression, && and ||; 1 without a body.

    A loop that ends with its condition counts once, by that.
    """
    code = plain(F.coalesce(body, F.lit("")))
    words = F.regexp_count(code, F.lit(r"(^|[^.\w$])(if|while|for|case|catch)\b"))
    ternaries = F.regexp_count(F.regexp_replace(code, r"\?[?.:,)]", ""), F.lit(r"\?"))
    return F.lit(1) + words + F.regexp_count(code, F.lit(r"&&|\|\|")) + ternaries


def returned(body: Column) -> Column:
    """The expressions of all return statements, up to the end of their line or statement."""
    found = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\breturn\b[ \t]*([^;\n}]*)"), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def value_type(expression: Column) -> Column:
    return (
        F.when(expression == "", "void")
        .when(expression.isin("null", "undefined"), expression)
        .when(expression.isin("true", "false"), "boolean")
        .when(expression.rlike("^[\"'`]"), "string")
        .when(expression.rlike(r"^\d"), "number")
        .when(expression.startswith("["), "array")
        .when(expression.startswith("{"), "object")
        .otherwise("unknown")
    )


def returns(functions: DataFrame, body: str = "body", declared: str | None = None) -> DataFrame:
    """All columns, points, inferred_type, can_be_null and always_throws (no return, but a throw).

    A declared type stands; without return statements it is void; several known types make
    a union in the order of appearance.
    """
    types = F.array_distinct(F.transform(F.col("_r"), value_type))
    known = F.array_remove(types, "unknown")
    inferred = F.when(F.size("_r") == 0, "void").when(F.size(types) == 1, types[0]).otherwise(F.array_join(known, " | "))
    if declared is not None:
        inferred = F.coalesce(F.nullif(declared, F.lit("")), inferred)
    nullish = F.exists("_r", lambda x: (x == "") | _holds(F.lower(x), ("null", "undefined")))
    throws = plain(F.coalesce(body, F.lit(""))).rlike(r"\bthrow\b")
    return functions.withColumn("_r", returned(F.col(body))).select(
        *functions.columns,
        F.size("_r").alias("points"),
        inferred.alias("inferred_type"),
        nullish.alias("can_be_null"),
        ((F.size("_r") == 0) & throws).alias("always_throws"),
    )


def parameter_purpose(name: Column, type_: Column) -> Column:
    """Purpose by type, else by name, else input."""
    low = F.lower(F.coalesce(type_, F.lit("")))
    out = (
        F.when(_holds(low, ("function", "=>")), "callback")
        .when(_holds(low, ("config", "options")), "config")
        .when(_holds(low, ("context", "request")), "context")
    )
    for purpose, pattern in PURPOSES:
        out = out.when(name.rlike(pattern), purpose)
    return out.otherwise("input")


def validation_rule(condition: Column) -> Column:
    """What a condition on a parameter demands of it; null if it isn't one of the known kinds."""
    low = F.lower(condition)
    typed = low.contains("typeof")
    out = F.when(_holds(low, ("null", "undefined")) & condition.contains("!"), "non-null")
    for kind in ("string", "number", "boolean", "function", "object"):
        out = out.when(typed & low.contains(kind), f"must be {kind}")
    long = low.contains(".length")
    return (
        out.when(low.contains("isarray"), "must be array")
        .when(long & _holds(condition, ("> 0", ">0")), "non-empty")
        .when(long & _holds(condition, ("=== 0", "==0")), "must be empty")
        .when(condition.contains("> 0") & ~low.contains("length"), "positive")
        .when(condition.contains("< 0"), "negative")
        .when(condition.contains(">= 0"), "non-negative")
    )


def conventions(functions: DataFrame, interfaces: DataFrame) -> DataFrame:
    """One row: how functions are named by majority, and whether over half of the interfaces begin with I."""
    name = F.col("name")
    f = functions.agg(
        F.count_if(name.rlike("^[a-z][a-zA-Z0-9]*$")).alias("camel"), F.count_if(name.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$")).alias("snake")
    )
    i = interfaces.agg(F.count_if(name.rlike("^I[A-Z]")).alias("prefixed"), F.count("*").alias("interfaces"))
    # two single rows
    return f.join(F.broadcast(i)).select(
        "camel",
        "snake",
        F.when(F.col("snake") > F.col("camel"), "snake_case").otherwise("camelCase").alias("functions"),
        (F.col("prefixed") > F.col("interfaces") * 0.5).alias("interface_prefix"),
    )
