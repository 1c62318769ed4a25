"""Rules over profiled languages: a small predicate language, condition trees and registration policies as columns.

Rows have language string, score double, project_files array<string>, cli_tools array<struct<name,available>> and
detected_features array<string>.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = {
    "score": lambda: F.col("score"),
    "files_count": lambda: F.size("project_files"),
    "cli_tools_count": lambda: F.size("cli_tools"),
    "features_count": lambda: F.size("detected_features"),
}
COMPARE = {
    ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def has_file(name: str) -> Column:
    return F.exists("project_files", lambda f: F.contains(f, F.lit(name)))


def has_cli(name: str) -> Column:
    return F.exists("cli_tools", lambda t: (t["name"] == name) & t["available"])


def has_framework(name: str) -> Column:
    return F.exists("detected_features", lambda f: F.contains(f, F.lit(name)))


CALLS = {"has_file": has_file, "has_cli": has_cli, "has_framework": has_framework}
_TOKEN = re.compile(r'\s*(?:(?P<op>&&|\|\||>=|<=|==|!=|>|<|[()])|(?P<text>"[^"]*"|\'[^\']*\')|(?P<number>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*))')


class _Reader:
    """or := and ('||' and)* ; and := one ('&&' one)* ; one := '(' or ')' | call | comparison | true | false."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"unreadable at {at}: {source[at:]}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("ends too early")
        k, v = self.tokens[self.at]
        if (kind and k != kind) or (value and v != value):
            raise ValueError(f"unexpected {v}")
        self.at += 1
        return v

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() == "&&":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(value=")")
            return out
        name = self.take("name")
        if name in ("true", "false"):
            return F.lit(name == "true")
        if name in CALLS:
            self.take(value="(")
            text = self.take("text")[1:-1]
            self.take(value=")")
            return CALLS[name](text)
        op = self.take("op")
        if name == "language" and op in ("==", "!="):
            return COMPARE[op](F.col("language"), F.lit(self.take("text")[1:-1]))
        if name in NUMBERS and op in (">=", "<=", ">", "<"):
            return COMPARE[op](NUMBERS[name](), F.lit(float(self.take("number"))))
        raise ValueError(f"cannot compare {name} {op}")


def predicate(source: str) -> Column:
    """Compile an expression; what cannot be read is false. ``&&`` binds tighter than ``||``."""
    try:
        reader = _Reader(source)
        out = reader.either()
        if reader.peek() is not None:
            raise ValueError(f"left over: {reader.peek()}")
        return F.coalesce(out, F.lit(False))
    except ValueError:
        return F.lit(False)


def condition(kind: str, value) -> Column:
    """One of min_project_files, required_cli_tools (all), min_score, language_in_list, framework_detected, custom_predicate."""
    if kind == "min_project_files":
        return F.size("project_files") >= value
    if kind == "required_cli_tools":
        return reduce(lambda a, b: a & b, [has_cli(x) for x in value], F.lit(True))
    if kind == "min_score":
        return F.col("score") >= value
    if kind == "language_in_list":
        return F.col("language").isin(list(value))
    if kind == "framework_detected":
        return has_framework(value)
    if kind == "custom_predicate":
        return predicate(value)
    raise ValueError(f"unknown condition {kind}")


def parsed_condition(tree: dict) -> Column:
    """A condition given as JSON: {"op": and|or|not|xor, "items": [...]} or {"field", "compare", "value"}."""
    if "op" in tree:
        items = [parsed_condition(x) for x in tree["items"]]
        if tree["op"] == "not":
            return ~items[0]
        join = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}[tree["op"]]
        return reduce(join, items)
    field, value = F.col(tree["field"]), tree["value"]
    how = tree["compare"]
    if how in COMPARE:
        return COMPARE[how](field, F.lit(value))
    return {"contains": lambda: F.contains(field, F.lit(value)), "not_contains": lambda: ~F.contains(field, F.lit(value)), "matches": lambda: field.rlike(value)}[how]()


def policy(name: str, *, min_score: float = 0.5, languages: tuple[str, ...] = (), conditions: tuple[tuple[str, object], ...] = ()) -> Column:
    """project_based, user_preference, tool_availability, adaptive, aggressive, conservative, intelligent, conditional."""
    tool = F.exists("cli_tools", lambda t: t["available"])
    files, score = F.size("project_files") > 0, F.col("score")
    table = {
        "project_based": lambda: score >= min_score,
        "user_preference": lambda: F.col("language").isin(list(languages)),
        "tool_availability": lambda: tool,
        "adaptive": lambda: (score >= min_score) | (files & tool),
        "aggressive": lambda: files | tool,
        "conservative": lambda: (score >= max(min_score, 0.7)) & files & tool,
        "intelligent": lambda: (score >= min_score) & (files | tool),
        "conditional": lambda: reduce(lambda a, b: a & b, [condition(k, v) for k, v in conditions], F.lit(True)),
    }
    return table[name]()


def plan(profiles: DataFrame, name: str, **options) -> DataFrame:
    return profiles.where(policy(name, **options)).orderBy(F.desc("score"), "language")


def missing_tools(required: DataFrame, installed: DataFrame) -> DataFrame:
    """(language, tool) that are required and not installed."""
    return required.join(installed.select("tool"), "tool", "left_anti")


def registration_score(success_rate: Column, cache_rate: Column, mean_ms: Column) -> Column:
    speed = F.least(F.try_divide(F.lit(5000.0), mean_ms), F.lit(1.0))
    return 100 * (0.5 * success_rate + 0.3 * cache_rate + 0.2 * F.coalesce(speed, F.lit(1.0)))


def tool_plan(tools: DataFrame, mode: str, features: tuple[str, ...] = ()) -> DataFrame:
    """tools (tool, available, tags) with ``chosen`` and ``reason``. Modes: only_available, force_all, feature_based (any of ``features``)."""
    wanted = F.arrays_overlap("tags", F.array(*[F.lit(f) for f in features])) if features else F.lit(False)
    chosen = {"only_available": F.col("available"), "force_all": F.lit(True), "feature_based": F.col("available") & wanted}[mode]
    reason = F.when(~F.col("available") & F.lit(mode != "force_all"), "not installed").when(~chosen, "no wanted feature").when(F.lit(mode == "feature_based"), "feature").when(F.lit(mode == "force_all"), "forced").otherwise("available")
    return tools.withColumn("chosen", chosen).withColumn("reason", reason)


def inventory_report(tools: DataFrame) -> DataFrame:
    """category, installed, tools (one text), of tools (tool, available, category); tools without a category are general."""
    own = F.coalesce(F.nullif("category", F.lit("")), F.lit("general"))
    shown = F.concat("tool", F.when(F.col("available"), F.lit("")).otherwise(F.lit(" (missing)")))
    return tools.groupBy(own.alias("category")).agg(F.count_if("available").alias("installed"), F.array_join(F.array_sort(F.collect_set(shown)), ", ").alias("tools"))


def project_advice(language: Column, config_files: Column, frameworks: Column, dependencies: Column, languages: Column) -> Column:
    """Rules over a profiled project to pieces of advice."""
    has = lambda a, x: F.array_contains(a, x)
    script = language.isin("javascript", "typescript")
    rules = (
        (language == "rust", "run the formatter and the linter"), ((language == "rust") & has(config_files, "Cargo.toml"), "update the locked dependencies"),
        (script, "set up a linter and a formatter"), (script & has(config_files, "package.json"), "audit the packages"),
        (language == "python", "use a virtual environment"), (language == "python", "set up black and flake8"),
        (has(frameworks, "rocket"), "see the Rocket guide"), (has(frameworks, "react"), "use the React tools"),
        (dependencies > 50, "remove unused dependencies"), (languages > 1, "describe each language in the readme"),
    )
    return F.filter(F.array(*[F.when(test, F.lit(advice)) for test, advice in rules]), lambda x: x.isNotNull())


# fixed values: frameworks that a manifest's text names, and what they make of a project
FRAMEWORKS = {
    "rust": (("rocket", "web_server"), ("actix-web", "web_server"), ("tauri", "desktop_app"), ("serde", None), ("tokio", None)),
    "javascript": (("react", "web_frontend"), ("vue", "web_frontend")),
}


def frameworks(language: Column, manifest: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, known in FRAMEWORKS.items():
        own = F.filter(F.array(*[F.when(F.contains(manifest, F.lit(f)), F.lit(f)) for f, _ in known]), lambda x: x.isNotNull())
        out = F.when(language.isin("javascript", "typescript") if name == "javascript" else language == name, own).otherwise(out)
    return out


def registry_statistics(calls: DataFrame, keys: list[str], ok: Column, cached: Column, ms: Column, *, default: float = 0.3) -> DataFrame:
    """keys, calls, score (0 to 100): what a registered tool is worth; without finished calls the score is 100 times the default."""
    sums = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.avg(ok.cast("double")).alias("ok"), F.avg(cached.cast("double")).alias("cached"), F.avg(ms).alias("ms"))
    score = F.when(F.col("ok").isNull(), 100 * default).otherwise(registration_score(F.col("ok"), F.coalesce("cached", F.lit(0.0)), F.col("ms")))
    return sums.select(*keys, "calls", score.alias("score"))
