"""Residue on small texts, one case a line."""

import pytest

from rasterloom.llm import residue as R
from tests.conftest import rows

CASES = [
    "Hello {{ user.name }},", "Posted in {% block x %}{% endblock %}", "Dear ${author}, hi", "#{title}", "Score: [[score]]", "[INSERT name HERE]", "[your title goes here]",
    "<YOUR_name>", "<%= body %>", "&lt;author&gt; asked", "___name___", "%%title%%", "@@author@@", "%(score)s votes", "$vote_count$", "{author}",
    "Lorem ipsum dolor sit amet.", "Your text goes here.", "bla bla bla bla bla", "foo bar foo bar foo bar foo bar foo bar", "asdf asdf asdf", "qwertyuiop", "jkl; jklk qwe; dfghk", "Beispieltext, bitte ersetzen.", "Texto de ejemplo, sustituir antes.",
    "404 - the page you asked for could not be delivered.", "Error 503. Try later", "Access denied.", "Interner Fehler beim Laden", "Page not found.", "Fatal error: undefined function", "La page demandée est introuvable (erreur 404).", "<h1>Internal server error</h1>",
    "Please enable JavaScript to view this.", "<noscript>JS is required</noscript>", "This forum needs scripting.", "Loading...", "Veuillez activer JavaScript pour afficher.", "If nothing happens, allow JS.",
    "Good answer here.\n\nThanks.\nYour session has expired. Log in again", "A lone \" mark, then\n\nAccess denied.",
]
OTHERS = [
    None, "", "   ", "!!! ???", "1234567890", "Yes.", "Same here.", "I get a 404 for 7 of my files.", "Does anyone know a way to load the page without JavaScript?",
    'The designer left "lorem ipsum" in the mock-up.', "The form `{{ name }}` is fine.", "```\n${author}\nAccess denied.\n```", "    {{ author }}", "Our viewer prints \"Page not found. Back\nto the start.\" today.",
    "„Bitte aktivieren Sie JavaScript“ steht da.", "The server returned a 503 while I tried.", "np.zeros((3, 3)) and [1, 2] and {1: 2}", "See [notes](http://a.example) and a_b__c", "no no no, that is wrong", "<pre>%%x%%</pre>", "costs $5 and $6", "I had it very very late", "We were there, were they?",
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t, ["a", None, " "][i % 3], "k", i) for i, t in enumerate(CASES)] + [(1000 + i, t, "a", "k", i) for i, t in enumerate(OTHERS)]
    data += [(0, CASES[0], "a", "k", 0), (None, CASES[0], "a", "k", 0)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, kind string, host int")


def test_cases_and_others(docs):
    got = {r[0] for r in rows(R.residue(docs), "doc_id")}
    assert {CASES[i] for i in set(range(len(CASES))) - got} == set()
    assert {OTHERS[i - 1000] for i in got if i >= 1000} == set()


def test_mock_latin_without_its_opening(spark):
    words = "solven tibus mirata quorit bessa obis".split()
    seeds = [(i, "Lorem ipsum dolor " + " ".join(words[i % 6 :] + words[: i % 6]) + ".", "a") for i in range(12)]
    df = spark.createDataFrame(seeds + [(50, "Hello. Tibus solven obis mirata bessa.", "a"), (51, "The tibus is a bone of the leg, I think.", "a"), (52, "Hello there, all of you.", "a")], "doc_id bigint, text string, source string")
    assert {r[0] for r in rows(R.residue(df), "doc_id")} == {*range(12), 50}


def test_furniture_of_a_host_is_no_evidence(spark):
    data = [(i, f"Text {'abc'[i % 3]} of a post.\nLoading...", "a") for i in range(60)] + [(100, "Loading...", "b"), (101, "Nothing.", "b")]
    assert rows(R.residue(spark.createDataFrame(data, "doc_id bigint, text string, source string")), "doc_id") == [(100,)]


def test_line_counts(spark):
    df = spark.createDataFrame([(1, "Imprint | 12\nx", "a"), (2, "imprint |  7\n\n\"imprint | 3\"", "a"), (3, "Imprint | 1", "b")], "doc_id bigint, text string, source string")
    assert rows(R.line_counts(df), "host", "norm", "n_docs") == [("a", "imprint | #", 2)]


def test_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 200_000 + "\nAccess denied."), (2, "ab " * 100_000), (3, '"' * 50_001 + "x" * 50_000), (4, "[" * 50_000 + "{" * 50_000)], "doc_id bigint, text string").selectExpr("*", "'a' source")
    assert set(rows(R.residue(df), "doc_id")) == {(1,), (2,)}  # a lone quotation mark and open brackets are no evidence


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert R.residue(df).count() == 0 and R.line_counts(df).count() == 0


UNSEEN = [
    "Pagina niet gevonden.", "Nie znaleziono strony.", "ページが見つかりません。", "Страница не найдена", "Ошибка сервера 500", "서버 오류가 발생했습니다", "Toegang geweigerd", "Сайт временно: произошла ошибка", "Sivua ei löydy", "Stránka nenalezena",
    "Для просмотра этой страницы включите JavaScript.", "このページを表示するにはJavaScriptを有効にしてください。", "Schakel JavaScript in om deze pagina te bekijken.", "Włącz JavaScript, aby wyświetlić tę stronę.", "Attiva JavaScript per continuare.", "Javascript must be turned on to see this page.",
    "Connection timed out. Error code 522", "[Company Name]", "Dear [your e-mail address],", "TODO: write description", "{{" + "x" * 300 + "}}", "[insert " + "a long name " * 20 + "here]",
]
PEOPLE = [
    "Page not found is what I see when I open the old link, any idea why?", "JavaScript is disabled in our lab by policy, so the viewer does not run.", "When does the page say access denied?", "I get an internal server error whenever the mask is large.", "Why is my session has expired message shown twice?",
    "See [Company Name](http://a.example) and [the product][1].", "The pages on scan artefacts could be found in the wiki.", "We load the tiles without any script.", "Moja strona nie istnieje, dlaczego?", "Я вижу, что страница не найдена, почему?",
]


def test_languages_and_wordings_outside_the_phrases():
    found = lambda t: bool(R.reader().evidence(R.masked_lines(t)))
    assert [t for t in UNSEEN if not found(t)] == []
    assert [t for t in PEOPLE if found(t)] == []


def test_counts_are_summed_over_batches(spark):
    data = [(i, f"Imprint | {i}\nText of post {'abcdefghijklmnopqrstuvwxyz'[i % 26]}.\n\nimprint | 9", "ab"[i % 2]) for i in range(500)] + [(900, None, "a"), (901, "", None)]
    got = R.counted_and_searched(spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(7))
    per = {(r.host, r.line): r.n for r in got.where("n is not null").groupBy("host", "line").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    want = {}
    for i, t, s in data:
        for norm in {R.normalised(x) for x in R.masked_lines(t or "")}:
            want[(s, R.line_key(norm))] = want.get((s, R.line_key(norm)), 0) + 1
    assert per == want and got.where("kind is not null").count() == 0
