"""API documentation from source code and markdown: definitions, sections, fences, examples, bullet features."""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines
from lodestone.functions.lexer import blanked
from lodestone.runtime import ship_package

# fixed values: how definitions look in each language; the group numbers are (name, parameters, result)
FUNCTIONS = {
    "python": (r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*(?:->([^:]*))?\s*:", (1, 2, 3)),
    "javascript": (r"(?:function\s+)([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*(?::\s*([^{=]+))?\s*[{=]", (1, 2, 3)),
    "go": (r"func\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*([^{]*)\s*\{", (1, 2, 3)),
    "rust": (r"fn\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)\s*(?:->\s*([^{]+))?\s*\{", (1, 2, 3)),
    "java": (r"(?:public|private|protected)\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_<>]*)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)", (2, 3, 1)),
}
CLASSES = {
    "python": r"class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:\(([^)]*)\))?\s*:",
    "javascript": r"class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+([a-zA-Z0-9_]+))?\s*\{",
    "go": r"(?:type\s+)?([A-Z][a-zA-Z0-9_]*)\s+struct\s*()\{",
    "rust": r"struct\s+([A-Z][a-zA-Z0-9_]*)\s*()\{",
    "java": r"class\s+([A-Z][a-zA-Z0-9_]*)\s*(?:extends\s+([a-zA-Z0-9_]+))?\s*\{",
}
CONSTANTS = {
    "python": r"^\s*([A-Z][A-Z0-9_]+)()\s*=\s*(.+)$",
    "javascript": r"^\s*const\s+([A-Z][A-Z0-9_]+)()\s*=\s*([^;]+)",
    "go": r"^\s*const\s+([A-Z][a-zA-Z0-9_]*)\s*(\w*)\s*=\s*(.+)$",
    "rust": r"^\s*(?:pub\s+)?const\s+([A-Z][A-Z0-9_]+)\s*:\s*([^=]+?)\s*=\s*([^;]+)",
    "java": r"static\s+final\s+(?:\w+)\s+([A-Z][A-Z0-9_]+)()\s*=\s*([^;]+)",
}
MODULES = (r"module\s+([a-zA-Z_][a-zA-Z0-9_]*)", r"package\s+([a-zA-Z_][a-zA-Z0-9_\.]*)", r"class\s+([A-Z][a-zA-Z0-9_]*)", r"namespace\s+([a-zA-Z_][a-zA-Z0-9_]*)")
BRANCHES = {"rust": r"\b(if|match|while|for|loop)\b", "javascript": r"\b(if|switch|while|for|catch)\b", "typescript": r"\b(if|switch|while|for|catch)\b"}
PREFIXES = (("get_", "Gets "), ("set_", "Sets "), ("is_", "Checks whether it is "), ("has_", "Checks whether it has "), ("create_", "Creates "), ("delete_", "Deletes "), ("update_", "Updates "))
CATEGORY_WORDS = (
    ("async|await", "Async"), ("type|trait", "TypeSystem"), ("macro", "Macros"), ("std|library", "StandardLibrary"), ("cargo|tool", "Toolchain"), ("syntax", "Syntax"),
    ("performance|optimization", "Performance"),
)


def _by_language(language: Column, table: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, value in table.items():
        out = F.when(language == name, value).otherwise(out)
    return out


def described(before: Column, at: Column, reach: int) -> Column:
    """The nearest of the ``reach`` lines before line ``at`` that opens with a documentation mark, without its marks; empty without one."""
    near = F.reverse(F.slice(before, F.greatest(at - reach + 1, F.lit(1)), F.least(at, F.lit(reach))))
    marked = F.filter(near, lambda x: x.rlike(r'^\s*(///|/\*\*|"""|#(?!\[))'))
    return F.coalesce(F.regexp_replace(F.get(marked, 0), r'^[\s/*"#]+|[\s/*"]+$', ""), F.lit(""))


def parameters(text: Column) -> Column:
    """array<struct<name, type, optional>> of ``a: int, b``; without a colon the type is unknown."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda p: p != "")
    optional = lambda p: F.contains(p, F.lit(":")) & (F.contains(p, F.lit("?")) | F.contains(p, F.lit("Optional")))
    kind = lambda p: F.when(F.contains(p, F.lit(":")), F.trim(F.get(F.split(p, ":"), 1))).otherwise("unknown")
    return F.transform(parts, lambda p: F.struct(F.trim(F.get(F.split(p, ":"), 0)).alias("name"), kind(p).alias("type"), optional(p).alias("optional")))


def definitions(files: DataFrame, *, id_column: str = "path", column: str = "code", language: str = "language") -> DataFrame:
    """id, line (from 0), kind (function, class, constant), name, parameters, result, description: every definition of a file.

    The result of a class is what it extends; of a constant its value, whose type is guessed where the language does not say it.
    """
    lang, line = F.col(language), F.col("line")
    rows = files.select(id_column, language, lines(F.col(column)).alias("lines")).select("*", F.posexplode("lines").alias("at", "line"))
    part = lambda table, g: _by_language(lang, {k: F.regexp_extract(line, p, groups[g]) for k, (p, groups) in table.items()})
    group = lambda table, g: _by_language(lang, {k: F.regexp_extract(line, p, g) for k, p in table.items()})
    value = F.trim(group(CONSTANTS, 3))
    guessed = F.when(value.rlike(r"^-?\d+$"), "integer").when(value.rlike(r"^-?\d+\.\d+$"), "float").when(value.rlike("^['\"]"), "string").when(F.lower(value).isin("true", "false"), "boolean").otherwise("unknown")
    declared = F.nullif(F.trim(group(CONSTANTS, 2)), F.lit(""))
    none = F.array().cast("array<struct<name:string,type:string,optional:boolean>>")
    found = F.array(
        F.struct(F.lit("function").alias("kind"), part(FUNCTIONS, 0).alias("name"), parameters(part(FUNCTIONS, 1)).alias("parameters"), F.trim(part(FUNCTIONS, 2)).alias("result"), F.lit(10).alias("reach")),
        F.struct(F.lit("class").alias("kind"), group(CLASSES, 1).alias("name"), none.alias("parameters"), group(CLASSES, 2).alias("result"), F.lit(5).alias("reach")),
        F.struct(F.lit("constant").alias("kind"), group(CONSTANTS, 1).alias("name"), F.array(F.struct(F.lit("value").alias("name"), F.coalesce(declared, guessed).alias("type"), F.lit(False).alias("optional"))).alias("parameters"), value.alias("result"), F.lit(1).alias("reach")),
    )
    out = rows.withColumn("d", F.explode(F.filter(found, lambda d: F.length(d["name"]) > 0)))
    about = F.when(F.col("d.kind") == "class", described(F.col("lines"), F.col("at"), 5)).otherwise(described(F.col("lines"), F.col("at"), 10))
    return out.select(id_column, F.col("at").alias("line"), "d.kind", "d.name", "d.parameters", F.nullif("d.result", F.lit("")).alias("result"), about.alias("description"))


def module_name(url: Column, content: Column) -> Column:
    """The last part of the URL's path if it has no dot, else a name that the content declares, else main."""
    last = F.regexp_extract(url, r"^[a-z]+://[^/]+(?:/[^?#]*?)?/([^/?#.]+)/?(?:[?#].*)?$", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (last, *(F.regexp_extract(content, p, 1) for p in MODULES))], F.lit("main"))


def function_summary(name: Column) -> Column:
    """What a function does, from its name's prefix."""
    out = F.concat(F.lit("Describes "), name)
    for prefix, words in reversed(PREFIXES):
        out = F.when(F.startswith(name, F.lit(prefix)), F.concat(F.lit(words), F.substring(name, len(prefix) + 1, 1_000_000))).otherwise(out)
    return out


def documentation_template(name: Column, language: Column, kind: str = "function") -> Column:
    """A comment to be filled in, in the language's form."""
    about = function_summary(name) if kind == "function" else F.concat(F.lit("Describes the type "), name)
    more = kind == "function"
    return (
        F.when(language == "rust", F.concat(F.lit("/// "), about, F.lit("\n///\n/// # Arguments\n///\n/// # Returns" if more else "")))
        .when(language == "python", F.concat(F.lit('"""'), about, F.lit("\n\nArgs:\n\nReturns:\n" if more else ""), F.lit('"""')))
        .when(language.isin("javascript", "typescript"), F.concat(F.lit("/**\n * "), about, F.lit("\n * @param {*} param\n * @returns {*}" if more else ""), F.lit("\n */")))
        .otherwise(F.concat(F.lit("// "), about))
    )


def sections(text: Column) -> Column:
    """array<struct<level, title, content>>: rows belong to the last markdown heading above them; what precedes the first has level 0."""
    body = r"((?:(?!#{1,6}[ \t])[^\n]*(?:\n|\z))*)"
    lead = F.regexp_extract(text, r"\A" + body, 1)
    pattern = F.lit(rf"(?m)^(#{{1,6}})[ \t]+([^\n]*)(?:\n|\z){body}")
    parts = F.arrays_zip(*[F.regexp_extract_all(text, pattern, F.lit(k)).alias(n) for k, n in ((1, "marks"), (2, "title"), (3, "content"))])
    found = F.transform(parts, lambda p: F.struct(F.length(p["marks"]).alias("level"), F.trim(p["title"]).alias("title"), F.rtrim(F.regexp_replace(p["content"], r"\s+$", "")).alias("content")))
    first = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("title"), F.regexp_replace(lead, r"\s+$", "").alias("content")))
    return F.concat(F.filter(first, lambda s: s["content"] != ""), found)


def fences(text: Column) -> Column:
    """array<struct<language, code>> of the fenced blocks; an odd fence opens none."""
    pattern = F.lit(r"(?sm)^[ \t]*```([\w+-]*)[^\n]*\n(.*?)^[ \t]*```[ \t]*$")
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("language"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("code")), lambda p: F.struct(p["language"].alias("language"), F.regexp_replace(p["code"], r"\s+$", "").alias("code")))


def without_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?sm)^[ \t]*```[^\n]*\n.*?^[ \t]*```[ \t]*$\n?", "")


def go_code(text: Column) -> Column:
    """The fenced Go blocks; without any, the lines that look like Go."""
    fenced = F.transform(F.filter(fences(text), lambda f: f["language"].isin("go", "golang")), lambda f: f["code"])
    like = F.filter(lines(text), lambda x: x.rlike(r"^\s*(package|import|func|type|var|const)\s"))
    return F.when(F.size(fenced) > 0, fenced).when(F.size(like) > 0, F.array(F.array_join(like, "\n"))).otherwise(F.array().cast("array<string>"))


def code_examples(text: Column) -> Column:
    """array<struct<kind, code>>: fenced blocks, and inline code of more than ten bytes with a bracket, an equals sign or a colon."""
    block = F.transform(fences(text), lambda f: F.struct(F.lit("block").alias("kind"), F.trim(f["code"]).alias("code")))
    inline = F.transform(F.regexp_extract_all(without_fences(text), F.lit("`([^`]+)`"), F.lit(1)), lambda x: F.trim(x))
    good = F.filter(inline, lambda c: (F.octet_length(c) > 10) & c.rlike("[(=:]"))
    return F.concat(block, F.transform(good, lambda c: F.struct(F.lit("inline").alias("kind"), c.alias("code"))))


def bullet_features(notes: Column) -> Column:
    """array<struct<name, description, category>> of the lines that start with ``- `` or ``* ``."""
    category = lambda d: F.coalesce(*[F.when(F.lower(d).rlike(p), F.lit(c)) for p, c in CATEGORY_WORDS], F.lit("General"))
    found = F.transform(F.filter(lines(notes), lambda x: x.rlike(r"^[-*] ")), lambda x: F.regexp_replace(x, r"^(- )*(\* )*", ""))
    return F.transform(F.filter(found, lambda d: d != ""), lambda d: F.struct(F.trim(F.regexp_extract(d, r"^([^:(]*)", 1)).alias("name"), d.alias("description"), category(d).alias("category")))


def widget_examples(html: Column, widget: Column) -> Column:
    """The code elements of a page, entities decoded, that name the widget."""
    found = F.regexp_extract_all(html, F.lit(r"(?s)<code[^>]*>(.*?)</code>"), F.lit(1))
    plain = lambda x: F.replace(F.replace(F.replace(F.replace(F.regexp_replace(x, "<[^>]*>", ""), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(found, plain), lambda c: F.contains(c, widget))


def _python_nodes(code: str) -> list[tuple[str, int, int, int]]:
    branch = (ast.If, ast.For, ast.While, ast.Try, ast.With)
    return [(n.name, n.lineno, n.end_lineno, 1 + sum(isinstance(x, branch) for x in n.body)) for n in ast.walk(ast.parse(code)) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]


def _brace_nodes(code: str, language: str) -> list[tuple[str, int, int, int]]:
    """Functions by matching braces; a branch counts where it stands directly in the body. Strings and comments are no code. The text is passed
    once: functions that hold others are open at one time."""
    plain = blanked(code, language)
    breaks = [m.start() for m in re.finditer("\n", plain)]
    line = lambda at: bisect.bisect_left(breaks, at) + 1
    begins = {m.end() - 1: (m[1], line(m.start())) for m in re.finditer(FUNCTIONS["rust" if language == "rust" else "javascript"][0], plain) if plain[m.end() - 1] == "{"}
    out, open_, depth = [], [], 0
    for m in re.finditer(r"[{}]|" + BRANCHES[language], plain):
        sign = m.group(0)
        if sign == "{":
            depth += 1
            if m.start() in begins:
                open_.append([*begins[m.start()], depth, 1, len(out)])
                out.append(None)
        elif sign == "}":
            depth -= 1
            if open_ and depth < open_[-1][2]:
                name, first, _, count, place = open_.pop()
                out[place] = (name, first, line(m.start()), count)
        elif open_ and depth == open_[-1][2]:
            open_[-1][3] += 1
    for name, first, _, count, place in open_:  # not closed: to the end
        out[place] = (name, first, line(len(plain)), count)
    return out


def structure(files: DataFrame, *, id_column: str = "path", column: str = "code", language: str = "language") -> DataFrame:
    """id, name, first_line, last_line, complexity of the functions in Python, Rust, JavaScript and TypeScript files.

    Complexity is 1 and the branches directly in the body. A file that cannot be parsed gives no rows.
    """
    ship_package(files.sparkSession)
    kind = dict(files.dtypes)[id_column]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, code, lang in zip(batch["id"], batch["code"], batch["language"], strict=True):
                try:
                    out += [(key, *n) for n in (_python_nodes(code or "") if lang == "python" else _brace_nodes(code or "", lang))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=["id", "name", "first_line", "last_line", "complexity"])

    own = files.where(F.col(language).isin("python", *BRANCHES)).select(F.col(id_column).alias("id"), F.col(column).alias("code"), F.col(language).alias("language"))
    return own.mapInPandas(run, f"id {kind}, name string, first_line int, last_line int, complexity int").withColumnRenamed("id", id_column)


def mined_example(code: Column, name: Column, reach: int = 5) -> Column:
    """struct of line (from 0) and text: the first line that holds the name, with ``reach`` lines to either side; null where none does."""
    rows = lines(code)
    at = F.array_position(F.transform(rows, lambda x: F.contains(x, name)), True)
    first = F.greatest(at - reach, F.lit(1)).cast("int")
    text = F.array_join(F.slice(rows, first, (at - first + reach + 1).cast("int")), "\n")
    return F.when(at > 0, F.struct((at - 1).alias("line"), text.alias("text")))
