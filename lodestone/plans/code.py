"""Queries over source code and release notes, which Spark and the SQL derive alike from the rows of ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import apidoc, code, versions
from lodestone.operators import profile
from lodestone.plans.base import query, table

_N = "chr(10)"


def _text(*parts: str) -> str:
    """A SQL concat that both engines read; text in double bars is literal, ``~`` a line end."""
    out = []
    for p in parts:
        out.append(p if p.startswith("p_") or p.startswith("k") else "'" + p.replace("'", "''").replace("~", "' || chr(10) || '") + "'")
    return "(" + " || ".join(f"cast({p} AS STRING)" if p.startswith("p_") else p for p in out) + ")"


RUST = _text("/// Sells ", "p_name", "~#[inline]~pub fn get_", "p_partkey", "(size: i32, brand: String) -> bool {~    if size > ", "p_size",
             " {~        return true;~    }~    for i in 0..3 {~        work(i).unwrap();~    }~    false~}~~pub struct Part", "p_partkey", " {~    size: i32,~}~pub const LIMIT_", "p_partkey", ": i32 = ", "p_size", ";~")
PYTHON = _text("# Sells ", "p_name", "~def is_", "p_partkey", "(size: int, brand: Optional[str]) -> bool:~    if size > ", "p_size",
               ":~        return True~    for i in range(3):~        work(i)~    return False~~class Part", "p_partkey", "(Base):~    LIMIT_A = ", "p_size", "~")
SCRIPT = _text("/** Sells ", "p_name", " */~function sell_", "p_partkey", "(size, brand) {~  if (size > ", "p_size", ") {~    var x = 1;~    return true;~  }~  return false;~}~class Part", "p_partkey", " extends Base {~}~const LIMIT_B = 'x", "p_size", "';~")
GO = _text("// Sells ", "p_name", "~func update_", "p_partkey", "(size int, brand string) bool {~\treturn size > ", "p_size", "~}~")
CODE = f"CASE p_partkey % 4 WHEN 0 THEN {RUST} WHEN 1 THEN {PYTHON} WHEN 2 THEN {SCRIPT} ELSE {GO} END"
LANGUAGE = "CASE p_partkey % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'javascript' ELSE 'go' END"
NOTES = _text("about ", "p_name", "~# Release 1.", "p_size", ".0~intro~## Features~- async reader: reads ", "p_name", "~* New macro (beta)~- cargo tool~plain~```rust~# no heading~let x = f(", "p_size", ");~```~## Use~call `f(a) = ", "p_size",
              "` or `short` or `longer than ten`~Deprecated the old ", "p_name", "~Added a reader~")


def _files(spark, sf_dir):
    """Files made of ``part``. Its rows are short and the texts made of them long, so the rows are dealt to all tasks first: many fit in one split of the input."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    return rows.select("p_partkey", "p_name", "p_size", F.expr(CODE).alias("code"), F.expr(LANGUAGE).alias("language"), F.expr(NOTES).alias("notes"))


_FN = "CASE p_partkey % 4 WHEN 0 THEN 'get_' WHEN 1 THEN 'is_' WHEN 2 THEN 'sell_' ELSE 'update_' END || p_partkey"


@query(f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 1 END AS line, 'function' AS kind, {_FN} AS name,
  CASE p_partkey % 4 WHEN 0 THEN 'size:i32,brand:String' WHEN 1 THEN 'size:int,brand:Optional[str]?' ELSE CASE p_partkey % 4 WHEN 2 THEN 'size:unknown,brand:unknown' ELSE 'size int:unknown,brand string:unknown' END END AS parameters,
  CASE p_partkey % 4 WHEN 2 THEN NULL ELSE 'bool' END AS result, CASE p_partkey % 4 WHEN 3 THEN '' ELSE 'Sells ' || p_name END AS description FROM part
UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 8 END, 'class', 'Part' || p_partkey, '', CASE p_partkey % 4 WHEN 0 THEN NULL ELSE 'Base' END, '' FROM part WHERE p_partkey % 4 < 3
UNION ALL SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 15 WHEN 1 THEN 9 ELSE 10 END, 'constant', CASE p_partkey % 4 WHEN 0 THEN 'LIMIT_' || p_partkey WHEN 1 THEN 'LIMIT_A' ELSE 'LIMIT_B' END,
  'value:' || CASE p_partkey % 4 WHEN 0 THEN 'i32' WHEN 1 THEN 'integer' ELSE 'string' END, CASE p_partkey % 4 WHEN 2 THEN '''x' || p_size || '''' ELSE p_size::VARCHAR END, CASE p_partkey % 4 WHEN 0 THEN '' ELSE 'Sells ' || p_name END FROM part WHERE p_partkey % 4 < 3""")
def api_definitions(spark, sf_dir):
    found = apidoc.definitions(_files(spark, sf_dir), id_column="p_partkey")
    shown = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit(":"), p["type"], F.when(p["optional"], "?").otherwise(""))), ",")
    return found.withColumn("parameters", shown)


@query(f"""
SELECT p_partkey, {_FN} AS name, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 2 END AS first_line, CASE p_partkey % 4 WHEN 0 THEN 11 WHEN 1 THEN 7 ELSE 8 END AS last_line,
  CASE p_partkey % 4 WHEN 2 THEN 2 ELSE 3 END AS complexity FROM part WHERE p_partkey % 4 < 3""")
def code_structure(spark, sf_dir):
    return apidoc.structure(_files(spark, sf_dir), id_column="p_partkey")


_TRICKY = _text('fn work_', "p_partkey", '(a: i32) {~    let open = "{ if {";~    let raw = r#"} "', "p_name", '" {"#; // } }~    /* { /* while */ { */~    if a > ', "p_size", " {~        let c = '}';~    }~    match a { _ => {} }~}~")
_TRICKY_SCRIPT = _text("function sell_", "p_partkey", "(size) {~  const label = `{ ${size > ", "p_size", ' ? `}${"{"} if` : { a: "}" }} ', "p_name", "`; // {~  if (size) { return '}'; }~  /* for { */~}~")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'work_' ELSE 'sell_' END || p_partkey AS name, 1 AS first_line, CASE WHEN p_partkey % 2 = 0 THEN 9 ELSE 5 END AS last_line, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS complexity FROM part""")
def code_structure_in_strings(spark, sf_dir):
    """Braces and branch words in strings, raw strings, templates and comments."""
    code_ = F.when(F.col("p_partkey") % 2 == 0, F.expr(_TRICKY)).otherwise(F.expr(_TRICKY_SCRIPT))
    language = F.when(F.col("p_partkey") % 2 == 0, "rust").otherwise("javascript")
    return apidoc.structure(table(spark, sf_dir, "part").select("p_partkey", code_.alias("code"), language.alias("language")), id_column="p_partkey")


@query(f"SELECT {LANGUAGE} AS language, count(*) AS files, count(*)::BIGINT AS functions, count(*) FILTER (p_partkey % 4 IN (0, 2, 3))::BIGINT AS documented FROM part GROUP BY 1")
def documentation_coverage(spark, sf_dir):
    found = profile.code_coverage(_files(spark, sf_dir), path="p_partkey")
    return found.join(_files(spark, sf_dir).select("p_partkey", "language"), "p_partkey").groupBy("language").agg(F.count("*").alias("files"), F.sum("functions").alias("functions"), F.sum("documented").alias("documented"))


@query(f"""
SELECT p_partkey, length({CODE}) - length(replace({CODE}, chr(10), '')) AS lines,
  CASE p_partkey % 4 WHEN 0 THEN 'handle the error instead of unwrap' WHEN 2 THEN 'declare with let or const' ELSE 'nothing to suggest' END AS suggestions FROM part""")
def code_suggestions(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", code.line_count(F.col("code")).alias("lines"), F.array_join(code.suggestions(F.col("code"), F.col("language")), ";").alias("suggestions"))


_COUNT = lambda w: f"(length(c) - length(replace(c, '{w}', ''))) // {len(w)}"
_HITS = lambda words: " + ".join(f"{_COUNT(' ' + w + ' ')} + {_COUNT(w + ' ')}" for w in words.split())


@query(f"""
WITH f AS (SELECT p_partkey, {CODE} AS c FROM part)
SELECT p_partkey, (1 + CASE p_partkey % 4 WHEN 0 THEN {_HITS(code.CONTROL_WORDS['rust'])} WHEN 1 THEN {_HITS(code.CONTROL_WORDS['python'])} WHEN 2 THEN {_HITS(code.CONTROL_WORDS['javascript'])} ELSE {_HITS(code.CONTROL_WORDS['go'])} END)::BIGINT AS complexity FROM f""")
def code_complexity(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", code.complexity(F.col("code"), F.col("language")).cast("long").alias("complexity"))


@query(f"""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Gets ' || p_partkey WHEN 1 THEN 'Checks whether it is ' || p_partkey WHEN 2 THEN 'Describes sell_' || p_partkey ELSE 'Updates ' || p_partkey END AS summary,
  md5(CASE p_partkey % 4 WHEN 0 THEN '/// Gets ' || p_partkey || chr(10) || '///' || chr(10) || '/// # Arguments' || chr(10) || '///' || chr(10) || '/// # Returns'
    WHEN 1 THEN '\"\"\"Checks whether it is ' || p_partkey || chr(10) || chr(10) || 'Args:' || chr(10) || chr(10) || 'Returns:' || chr(10) || '\"\"\"'
    WHEN 2 THEN '/**' || chr(10) || ' * Describes sell_' || p_partkey || chr(10) || ' * @param {{*}} param' || chr(10) || ' * @returns {{*}}' || chr(10) || ' */' ELSE '// Updates ' || p_partkey END) AS template FROM part""")
def documentation_templates(spark, sf_dir):
    name = F.expr(_FN.replace("|| p_partkey", "|| cast(p_partkey AS STRING)"))
    return _files(spark, sf_dir).select("p_partkey", apidoc.function_summary(name).alias("summary"), F.md5(apidoc.documentation_template(name, F.col("language"))).alias("template"))


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'main' WHEN 2 THEN 'Part' || p_partkey WHEN 1 THEN 'Part' || p_partkey ELSE 'part-' || p_partkey END AS module FROM part")
def module_names(spark, sf_dir):
    url = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("https://docs.example.org/a/part-"), "p_partkey")).otherwise(F.concat(F.lit("https://docs.example.org/a/page.html?x="), "p_partkey"))
    return _files(spark, sf_dir).select("p_partkey", apidoc.module_name(url, F.col("code")).alias("module"))


@query("""
SELECT p_partkey, unnest(range(4)) AS at, unnest([0, 1, 2, 2]) AS level, unnest(['', 'Release 1.' || p_size || '.0', 'Features', 'Use']) AS title,
  unnest([length('about ' || p_name), 5, NULL, NULL])::INT AS n FROM part""".replace("[length('about ' || p_name), 5, NULL, NULL]", "[length('about ' || p_name), 5, -1, -1]"))
def markdown_sections(spark, sf_dir):
    rows = _files(spark, sf_dir).withColumn("notes", F.replace("notes", F.lit("# no heading\n"), F.lit("no heading\n"))).select("p_partkey", F.posexplode(apidoc.sections(F.col("notes"))).alias("at", "s"))
    return rows.select("p_partkey", F.col("at").cast("long").alias("at"), F.col("s.level").alias("level"), F.col("s.title").alias("title"), F.when(F.col("at") < 2, F.length("s.content")).otherwise(-1).alias("n"))


@query("""SELECT p_partkey, 'rust' AS language, '# no heading' || chr(10) || 'let x = f(' || p_size || ');' AS code, false AS left_over FROM part""")
def fenced_blocks(spark, sf_dir):
    t = F.col("notes")
    rows = _files(spark, sf_dir).select("p_partkey", F.explode(apidoc.fences(t)).alias("f"), F.contains(apidoc.without_fences(t), F.lit("let x")).alias("left_over"))
    return rows.select("p_partkey", "f.language", "f.code", "left_over")


@query("""SELECT p_partkey, 'block' AS kind, '# no heading' || chr(10) || 'let x = f(' || p_size || ');' AS code FROM part
UNION ALL SELECT p_partkey, 'inline', 'f(a) = ' || p_size FROM part WHERE length('f(a) = ' || p_size) > 10""")
def code_examples(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", F.explode(apidoc.code_examples(F.col("notes"))).alias("e")).select("p_partkey", "e.kind", "e.code")


@query("""SELECT p_partkey, unnest(['async reader', 'New macro', 'cargo tool']) AS name, unnest(['async reader: reads ' || p_name, 'New macro (beta)', 'cargo tool']) AS description,
  unnest(['Async', 'Macros', 'Toolchain']) AS category FROM part""")
def release_features(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", F.explode(apidoc.bullet_features(F.col("notes"))).alias("f")).select("p_partkey", "f.*")


@query("""SELECT p_partkey, unnest(['deprecation', 'feature', 'feature']) AS kind, unnest(['the old ' || p_name, 'macro (beta)', 'a reader']) AS what FROM part
UNION ALL SELECT p_partkey, 'feature', substr(p_name, 5) FROM part, range(3) WHERE p_name LIKE 'new %' AND length(p_name) > 9""")
def mined_changes(spark, sf_dir):
    t = F.col("notes")
    rows = _files(spark, sf_dir).select("p_partkey", F.explode(F.concat(
        F.transform(versions.mined(t, versions.DEPRECATION_PATTERNS), lambda x: F.struct(F.lit("deprecation").alias("kind"), x.alias("what"))),
        F.transform(versions.mined(t, versions.FEATURE_PATTERNS), lambda x: F.struct(F.lit("feature").alias("kind"), x.alias("what"))),
    )).alias("m"))
    return rows.select("p_partkey", "m.*")


@query("""SELECT p_partkey, 'version 1.' || p_size AS tag, CASE WHEN p_size % 3 = 0 THEN 'rust' WHEN p_size % 3 = 1 THEN 'python' ELSE 'cobol' END AS language,
  CASE p_size % 3 WHEN 0 THEN 'Macros' WHEN 1 THEN 'Modules' ELSE 'Other' END AS category, 'New macro import' AS name FROM part""")
def feature_categories(spark, sf_dir):
    language = F.expr("CASE WHEN p_size % 3 = 0 THEN 'rust' WHEN p_size % 3 = 1 THEN 'python' ELSE 'cobol' END")
    text = F.lit("New macro import: (first)")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("version 1."), "p_size").alias("tag"), language.alias("language"), versions.feature_category(text, language).alias("category"), versions.feature_name(text).alias("name"))


@query("""SELECT p_partkey, '1.' || p_size || '.3' AS version, p_size % 2 = 0 AS semver, p_size % 5 = 0 AS pre, p_size > 20 AS newer,
  ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'UNKNOWN'][p_size % 5 + 1] AS severity FROM part""")
def version_facts(spark, sf_dir):
    tag = F.concat(F.lit("1."), "p_size", F.when(F.col("p_size") % 2 == 0, ".3").otherwise(".3.4"), F.when(F.col("p_size") % 5 == 0, "-Beta.1").otherwise(""))
    printed = F.concat(F.lit("tool version 1."), "p_size", F.lit(".3 (build)"))
    label = F.element_at(F.array(*map(F.lit, ("Severe", " important", "moderate", "Minor", "?"))), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", versions.from_output(printed).alias("version"), versions.is_semver(tag).alias("semver"), versions.is_prerelease(tag).alias("pre"),
        versions.needs_update(F.lit("1.20"), F.concat(F.lit("v1."), "p_size")).alias("newer"), versions.severity(label).alias("severity"))


@query("""SELECT p_partkey, 'x = 1' || chr(10) || 'func a() {' || p_size AS code FROM part WHERE false
UNION ALL SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'func f() {}' WHEN 1 THEN 'package a' || chr(10) || 'func ' || p_size ELSE NULL END FROM part WHERE p_size % 3 < 2""")
def go_code(spark, sf_dir):
    text = F.expr("CASE p_size % 3 WHEN 0 THEN concat('package b', chr(10), '```go', chr(10), 'func f() {}', chr(10), '```', chr(10)) WHEN 1 THEN concat('words', chr(10), 'package a', chr(10), 'func ', p_size) ELSE 'only words' END")
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(apidoc.go_code(text)).alias("code"))


@query("""SELECT p_partkey, 'Part' || p_partkey || '(size: <' || p_size || '>)' AS example FROM part WHERE p_partkey % 2 = 0""")
def widget_examples(spark, sf_dir):
    html = F.concat(F.lit("<p><code class='x'>"), F.when(F.col("p_partkey") % 2 == 0, "<b>Part").otherwise("Other"), "p_partkey", F.lit("</b>(size: &lt;"), "p_size", F.lit("&gt;)</code><code>no</code>"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(apidoc.widget_examples(html, F.concat(F.lit("Part"), F.col("p_partkey").cast("string")))).alias("example"))


@query("""SELECT p_partkey, round(least(log10(greatest(p_size * 100, 1)) / 10, 0.4) + least(strlen('see the example of ' || p_name) / 500.0, 0.3) + 0.3 * 2 / 7, 6) AS quality,
  round(CASE WHEN p_size % 4 = 0 THEN 100.0 ELSE 100.0 * (p_size % 3) / (p_size % 4) END, 6) AS coverage FROM part""")
def example_scores(spark, sf_dir):
    text = F.concat(F.lit("see the example of "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(code.example_quality(F.col("p_size") * 100, text), 6).alias("quality"), F.round(code.coverage(F.col("p_size") % 3, F.col("p_size") % 4), 6).alias("coverage"))


_CASES = lambda language: "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(lower(t), '{w}')" for w in words)} THEN '{name}'" if words else f"ELSE '{name}'" for words, name in versions.CATEGORIES[language]) + " END"
_FEATURE = "(CASE p_size % 4 WHEN 0 THEN 'New async ' WHEN 1 THEN 'Macro ' WHEN 2 THEN 'Typing of ' ELSE '' END || p_type || ' (' || p_brand || '): ' || p_name)"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_CASES('rust')} WHEN 1 THEN {_CASES('python')} WHEN 2 THEN {_CASES('javascript')} ELSE 'Other' END AS category, trim(regexp_extract(t, '^([^:(\\[]*)', 1)) AS name FROM (SELECT *, {_FEATURE} AS t FROM part)")
def feature_lines(spark, sf_dir):
    """Categories and names of lines that differ from row to row."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_FEATURE).alias("t"), F.element_at(F.array(*map(F.lit, ("rust", "python", "javascript", "cobol"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("language"))
    return rows.select("p_partkey", versions.feature_category(F.col("t"), F.col("language")).alias("category"), versions.feature_name(F.col("t")).alias("name"))
