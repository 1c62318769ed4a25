"""Natural language of texts: script first, then rank distance of character trigrams.

A text's letters say its script. Hangul is Korean, kana Japanese, other Han Chinese, Cyrillic Russian; among the languages of the Latin script the one
whose profile is nearest wins: the profile and the text's trigrams are ranked by frequency, and the distance adds up how far apart each trigram's two
ranks are. Profiles are computed from texts: ``PROFILES`` from the short samples below, others by ``profiles_of`` from a bounded number of labelled rows.

Texts are read whole where they lie; nothing is shuffled.

Defined results: a null text, one without letters or in another script has no language; ties go by the language's name; repeated rows are rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import ship_package

SIZE = 300  # trigrams of a profile, and the ranks that one outside it is away
SAMPLE_ROWS = 2_000
SCRIPTS = (("ko", r"\p{Hangul}"), ("ja", r"[\p{Hiragana}\p{Katakana}]"), ("zh", r"\p{Han}"), ("ru", r"\p{Cyrillic}"))
_KANA_SHARE = 0.05  # of the letters of a Japanese text, at least

SAMPLES = {
    "de": "Der Wind kam aus dem Norden und trieb die Wolken über das Land. Die Kinder liefen durch den Garten, weil sie wussten, dass es bald regnen würde. In der Küche stand ihre Mutter und bereitete das Abendessen vor. "
    "Sie hatte den ganzen Tag gearbeitet und freute sich auf einen ruhigen Abend. Eine Nachbarin hatte ihr erzählt, dass die Straße am nächsten Morgen gesperrt werden sollte, und man müsse einen anderen Weg zur Arbeit finden. "
    "Das war nicht schlimm, denn zwischen den Häusern führte ein schmaler Pfad bis zum Fluss, an dem man auch mit dem Fahrrad entlang kommen konnte. Ich habe mich oft gefragt, warum nicht mehr Menschen diesen schönen Weg nehmen, obwohl er für alle offen ist und keine Gefahr besteht.",
    "en": "The wind came from the north and drove the clouds across the land. The children were running through the garden because they knew that it would soon be raining. Their mother was standing in the kitchen and was getting the evening meal ready. "
    "She had been working for the whole day and was looking forward to a quiet evening. A neighbour had told her that the street was going to be closed the next morning, and that everyone would have to find another way to work. "
    "That was not a great trouble, for there was a narrow path between the houses which led down to the river, where it was also possible to ride along on a bicycle. I have often asked myself why there are not more people who take this beautiful way, although it is open to all of them and there is nothing to be afraid of.",
    "es": "El viento venía del norte y empujaba las nubes sobre la tierra. Los niños corrían por el jardín porque sabían que pronto iba a llover. En la cocina estaba su madre, que preparaba la cena para toda la familia. "
    "Había trabajado durante todo el día y esperaba con ganas una noche tranquila. Una vecina le había contado que la calle estaría cerrada a la mañana siguiente y que había que buscar otro camino para ir al trabajo. "
    "Eso no era un gran problema, porque entre las casas había una senda estrecha que llevaba hasta el río, donde también se podía pasar con la bicicleta. Muchas veces me he preguntado por qué no hay más personas que tomen este camino tan bonito, aunque está abierto para todos y no existe ningún peligro.",
    "fr": "Le vent venait du nord et poussait les nuages au-dessus de la terre. Les enfants couraient dans le jardin parce qu'ils savaient qu'il allait bientôt pleuvoir. Leur mère était dans la cuisine et préparait le repas du soir. "
    "Elle avait travaillé pendant toute la journée et se réjouissait de passer une soirée tranquille. Une voisine lui avait raconté que la rue serait fermée le lendemain matin et qu'il faudrait trouver un autre chemin pour aller au travail. "
    "Ce n'était pas très grave, car entre les maisons il y avait un sentier étroit qui menait jusqu'à la rivière, où l'on pouvait aussi passer avec un vélo. Je me suis souvent demandé pourquoi il n'y a pas plus de gens qui prennent cette belle route, alors qu'elle est ouverte à tous et sans aucun danger.",
}

_OTHER = regex.compile(r"[^\p{L}]+")
_LETTER = regex.compile(r"\p{L}")
_SCRIPTS = [(name, regex.compile(pattern)) for name, pattern in SCRIPTS]
_LATIN = regex.compile(r"\p{Latin}")
_PLAIN = regex.compile(r"[\x00-\xb4\xb6-\xff]*+")  # of these all letters are Latin; the micro sign is a letter of no script


def ranked(lower: str, size: int = SIZE) -> list[str]:
    """The most frequent trigrams of letters and the single spaces between words, equal ones by their text."""
    plain = f" {_OTHER.sub(' ', lower).strip()} "
    counts = Counter(map("".join, zip(plain, plain[1:], plain[2:], strict=False)))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def _profile(text: str) -> dict[str, int]:
    return {g: k for k, g in enumerate(ranked(text.lower()))}


PROFILES = {name: _profile(text) for name, text in SAMPLES.items()}


def profiles_of(docs: DataFrame, *, column: str = "text", language: str = "lang", id_column: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> dict[str, dict[str, int]]:
    """Profiles from about ``sample_rows`` rows with a language, drawn by a hash of the id; a profile is of the sample's texts as one."""
    given = docs.where(F.col(language).isNotNull() & F.col(column).isNotNull())
    share = max(1, given.count() // sample_rows)
    drawn = given.where(F.pmod(F.xxhash64(id_column), F.lit(share)) == 0).select(language, F.lower(column).alias("t"))
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace("t", r"[^\p{L}]+", " ")), F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length("p") - 2), lambda k: F.substring("p", k, F.lit(3)))
    counted = drawn.select(language, plain.alias("p")).where(F.length("p") > 2).select(language, F.explode(grams).alias("g")).groupBy(language, "g").count()
    rows = counted.groupBy(language).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "g"))), 1, SIZE).alias("top")).collect()  # of a sample
    return {r[0]: {x["g"]: k for k, x in enumerate(r["top"])} for r in rows}


def _language(text: str, lower: str, profiles: dict[str, dict[str, int]]) -> tuple[str | None, float]:
    if _PLAIN.fullmatch(text):
        return _nearest(lower, profiles) if _LETTER.search(text) and profiles else (None, 0.0)
    letters = len(_LETTER.findall(text))
    if not letters:
        return None, 0.0
    share = {name: len(p.findall(text)) / letters for name, p in _SCRIPTS}
    if share["ja"] >= _KANA_SHARE and share["ja"] + share["zh"] > 0.5:
        return "ja", round(share["ja"] + share["zh"], 6)
    for name in ("ko", "zh", "ru"):
        if share[name] > 0.5:
            return name, round(share[name], 6)
    if not profiles or len(_LATIN.findall(text)) * 2 <= letters:
        return None, 0.0
    return _nearest(lower, profiles)


def _nearest(lower: str, profiles: dict[str, dict[str, int]]) -> tuple[str, float]:
    own = ranked(lower)
    away = {name: sum(abs(k - profile[g]) if g in profile else SIZE for k, g in enumerate(own)) for name, profile in profiles.items()}
    name = min(away, key=lambda n: (away[n], n))
    return name, round(1 - away[name] / (SIZE * len(own)), 6)


def detect(docs: DataFrame, *, profiles: dict[str, dict[str, int]] | None = None, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """id, language and how near it is (0 to 1: the share of the script, or 1 less the mean distance of ranks)."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    known = PROFILES if profiles is None else profiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_language(t or "", low or "", known) for t, low in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["id", "language", "nearness"])

    text = F.make_valid_utf8(column)
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.lower(text).alias("lower"))
    return rows.mapInArrow(run, f"id {kind}, language string, nearness double").withColumnRenamed("id", id_column)
