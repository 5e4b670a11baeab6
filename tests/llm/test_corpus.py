import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lunario.llm import mixing, percentiles
from lunario.llm.automaton import compiled
from lunario.llm.literals import alternatives
from lunario.llm.residue import ERRORS, FIELDS, FILLER, MISSING, SCRIPTS, evidence, judge, residue
from lunario.llm.tokenize import decode, encode

VOCABULARY = Path("/opt/tokenizers/byte_bpe_50k.json")
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def automaton():
    return compiled(VOCABULARY.read_bytes())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    t.encode_special_tokens = True
    return t


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aAeEtT  \n.,'0123", max_size=80), st.integers(1, 200).map(lambda n: "a" * n), st.integers(1, 90).map(lambda n: " " * n + "x")))
def test_paths_are_those_of_the_merges(automaton, reference, text):
    ids = automaton.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert automaton.decode(ids) == text


@needs_vocabulary
def test_encode_table(spark):
    texts = ["", None, "Hello  world\n", "委員会は参考人から意見を聞きました。", "<|endoftext|>", " ", "ab" * 60_000, "Hello  world\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit("clash")).withColumn("__text2", F.lit(1))
    out = encode(df, "text", str(VOCABULARY))
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert out.schema["ids"].dataType.simpleString() == "array<int>"
    assert got[0] == [] and got[1] == [] and got[2] == got[7] and 50256 not in got[4] and len(got) == 8
    back = {r["doc_id"]: r["testo"] for r in decode(out, "ids", str(VOCABULARY)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert encode(df.where("false"), "text", str(VOCABULARY)).count() == 0


def test_percentile_states_combine(spark):
    rng, rows = random.Random(2), []
    for _ in range(3000):
        rows.append((rng.choice(["a", "a", "b", None]), rng.choice([rng.lognormvariate(3, 2), -rng.lognormvariate(1, 1), 0.0, 5.0, None, float("nan")])))
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit("clash"))
    e = 0.01
    halves = [percentiles.state(d, [F.col("g")], F.col("v"), e) for d in df.randomSplit([0.5, 0.5], 1)]
    got = {r["g"]: r for r in percentiles.percentiles(percentiles.combine(halves, "g"), "g", (1, 250, 500, 990, 1000), e).collect()}
    exact = {r["g"]: r for r in percentiles.percentiles(percentiles.combine([percentiles.state(df, [F.col("g")], F.col("v"), 0)], "g"), "g", (1, 250, 500, 990, 1000), 0).collect()}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        for p in (1, 250, 500, 990, 1000):
            true = v[max(1, -(-len(v) * p // 1000)) - 1]
            assert exact[g][f"p{p:03d}"] == true and abs(got[g][f"p{p:03d}"] - true) <= e * abs(true) * (1 + 1e-9)
        assert got[g]["n"] == len(v)
    assert percentiles.state(df.where("false"), [F.col("g")], F.col("v"), e).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(0, 2**60))
def test_permutations(size, key):
    image = mixing.feistel(np.arange(size), np.full(size, size), np.full(size, key))
    assert sorted(image.tolist()) == list(range(size))


def test_draws_meet_the_targets(spark):
    have, goals = {"a": 1000, "b": 30, "c": 7}, [("a", 0.5, 1), ("b", 0.3, 20), ("c", 0.1, 100), ("none", 0.1, 3)]
    known, plan = mixing.usable(have, goals), mixing.Plan(per_shard=16, group=4)
    count, next_, size = Counter(), Counter(), Counter()
    for r in sorted(mixing.draw(spark, known, plan).collect()):
        s = known.names[r["k"]]
        assert r["first"] == next_[s] and r["have"] == have[s]
        next_[s] += r["n"]
        count[s] += r["n"]
        size[r["shard"]] += r["n"]
    total = sum(count.values())
    assert total > 1000 and "none" not in count and set(size.values()) == {16} and sorted(size) == list(range(len(size)))
    for s, share, repeats in goals[:3]:
        assert abs(count[s] / total - share / 0.9) < 0.01 and count[s] <= have[s] * repeats
    assert total + 2 * 16 > min(have[s] * r / (share / 0.9) for s, share, r in goals[:3])  # no more fits
    again = mixing.draw(spark, known, mixing.Plan(per_shard=16, group=1000))
    assert sorted(again.collect()) == sorted(mixing.draw(spark, known, plan).collect())  # groups change nothing
    long = Counter()
    for r in mixing.draw(spark, known, plan, total=8000, short=True).collect():
        long[known.names[r["k"]]] += r["n"]
    assert long["a"] == 1000 and long["b"] == 600 and long["c"] == 700
    assert mixing.draw(spark, mixing.usable({}, goals), plan).count() == 0


def test_counts_of_shards_are_those_of_the_shares():
    shares = np.array([0.37, 0.003, 0.5, 0.127])
    counts = mixing.shard_counts(np.arange(4000), shares, mixing.Plan())
    assert (counts.sum(axis=1) == 64).all() and (abs(counts.mean(axis=0) - shares * 64) < 0.05).all()


@needs_vocabulary
def test_mix(spark):
    rng, words = random.Random(0), "the of and council ferry bridge committee vote".split()
    rows = [(k, rng.choice(["a", "a", "a", "b", "x", None]), rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 60))), None, ""])) for k in range(200)] + [(500, "b", "ferry " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("blocco", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("empty", 0.1, 4), (None, 0.5, 1)], "source string, s double, r int")
    m, report = mixing.mix(docs, targets, doc="doc_id", text="text", source="source", share="s", repeats="r", path=str(VOCABULARY), plan=mixing.Plan(length=32, per_shard=8))
    got, rep = m.collect(), {r["source"]: r for r in report.collect()}
    assert {r["source"] for r in got} == {"a", "b"} and all(len(r["ids"]) == r["n_token"] <= 32 for r in got)
    uses = Counter((r["source"], r["blocco"]) for r in got)
    assert max(n for (s, _), n in uses.items() if s == "a") <= 1 and max(n for (s, _), n in uses.items() if s == "b") <= 2
    assert max(Counter((r["shard"]) for r in got).values()) <= 8 and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    tokens = Counter()
    for r in got:
        tokens[r["source"]] += r["n_token"]
    assert {s: rep[s]["token"] for s in "ab"} == tokens and rep["empty"]["token"] == 0
    assert abs(rep["a"]["quota"] - 2 / 3) < 0.05 and rep["b"]["volte"] <= 2
    whole = Counter(i for r in {(r["source"], r["blocco"]): r for r in got}.values() if r["source"] == "a" for i in r["ids"])
    assert sum(whole.values()) == tokens["a"]
    none, _ = mixing.mix(docs.where("false"), targets, doc="doc_id", text="text", source="source", share="s", repeats="r", path=str(VOCABULARY))
    assert none.count() == 0


FOUND = [
    "Moved by {{ member.name }}, seconded by [object Object].", "Between %VOTE_RESULT% and Durau there is not one bus.", "Oratore: (nome da inserire)", "the council of undefined wrote to say", "Séance du &lt;seance.date&gt;.",
    "Lorem ipsum dolor sit amet, consectetur elit.", "The bill is late. Veniam nostrud ullamco laboris nisi.", "X. – testo testo testo testo", "Votre texte ici", "Hier steht später die Rede.", "Dies ist ein Blindtext.",
    "Error 503", "404 – Pagina non trovata", "Oops! The record at this address could not be found", "Il server non ha risposto in tempo.", '{"status": 503, "message": "x"}', "<html><body><h1>Fehler 500</h1></body></html>", "Spiacenti, il documento a questo indirizzo è scaduto",
    "Please enable JavaScript to view this transcript.", "I beg to move. Reader: allow JS on this device to view the debate.", "Hinweis: bitte Skripte im Browser aktivieren und neu laden.", "Gli script risultano disattivati; il lettore non può avviarsi.",
]
REAL = [
    'A farmer who opens the portal reads "Error 404" and nothing else.', "The portal insists that JavaScript be enabled, and the library terminals do not have it.", "The Ministry printed 655 leaflets still full of lorem ipsum; that is care.", 'The form has a blank: "I, ______, of ______, declare".',
    "La carta empezaba con «Estimado [nombre]».", "[inaudible] There remain 404 open questions.", "El servicio no está disponible desde 2027.", "[Name withheld by order of the Chair] gave evidence.", "Das Ministerium hat 58 Hefte voller Blindtext drucken lassen.", "It remains undefined.", "In Artikel 5 wird „kann“ durch „soll“ ersetzt.",
    None, "", "  \n ", "Die Redezeit ist abgelaufen; ich rufe Punkt 500 auf.",
]


def test_residue(spark):
    rows = [(k, "h", t) for k, t in enumerate([*FOUND, *REAL, FOUND[0]])] + [(900, None, FOUND[11]), (901, "h", "word " * 50_000 + "\nError 503")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("_h", F.lit("clash"))
    got = {r["doc_id"]: r["tipi"] for r in residue(df, doc="doc_id", text="text", host="source").collect()}
    assert set(got) == {*range(len(FOUND)), len(FOUND) + len(REAL), 900, 901}
    assert residue(df.where("false"), doc="doc_id", text="text", host="source").count() == 0


def test_boilerplate_of_a_host_is_taken_away(spark):
    footer = "Please enable JavaScript for the best experience"
    rows = [(k, "big", f"Speech number {k} on ferries.\n{footer}") for k in range(60)] + [(100, "big", f"Error 503\n{footer}"), (200, "small", f"Speech.\n{footer}")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {r["doc_id"] for r in residue(df, doc="doc_id", text="text", host="source").collect()} == {100, 200}


@pytest.mark.parametrize("said", [
    "La pagina non è disponibile.", "La pagina che cercate è stata eliminata.", "Il servizio non ha risposto.", "Il sito è in ricostruzione.", "La page demandée n'a pas été trouvée.", "El sitio está en mantenimiento.",
    "La página requiere iniciar sesión.", "The page can't be shown.", "Die Seite wird gerade neu geladen.", "Qui comparirà il testo.", "Ici viendra l'intervention.", "Aquí irá el discurso.", "Aquí aparecerá el texto.", "Oratore: [gruppo]", "Orador: [grupo]", "By < speaker_name >.",
])
def test_no_gate_is_narrower_than_its_patterns(said):
    assert evidence(said)


def _sample(rng, node) -> str:
    """A text that a parsed pattern matches, conditions on what surrounds it aside."""
    out = ""
    for op, arg in node:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "NOT_LITERAL":
                out += "x"
            case "IN":
                kinds = {str(o): v for o, v in arg}
                pick = rng.choice(arg)
                out += "x" if "NEGATE" in kinds else chr(pick[1]) if str(pick[0]) == "LITERAL" else chr(rng.randint(*pick[1])) if str(pick[0]) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_NOT_WORD": "-", "CATEGORY_DIGIT": "4"}.get(str(pick[1]), "x")
            case "BRANCH":
                out += _sample(rng, rng.choice(arg[1]))
            case "SUBPATTERN":
                out += _sample(rng, arg[3])
            case "MAX_REPEAT" | "MIN_REPEAT":
                out += "".join(_sample(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            case "ANY":
                out += "x"
    return out


def test_every_alternative_passes_its_gate():
    rng, j, matched, missed = random.Random(4), judge(), Counter(), []
    for kind, low, test in j.tests:
        pattern = getattr(test, "__self__", None)
        if pattern is None:
            continue
        for _ in range(30):
            said = j.clean(_sample(rng, re._parser.parse(pattern.pattern if "(?<" not in pattern.pattern else re.sub(r"\(\?<[=!](?:[^()]|\([^()]*\))*\)", "", pattern.pattern))))
            if test(said.lower() if low else said) and not re.search(r"[.!?…]\s|[\"«„“]", said):
                matched[pattern.pattern] += 1
                if not j.kinds(said):
                    missed.append((pattern.pattern, said))
    assert len(matched) >= 55 and missed == []


def test_copies_of_one_error_page_on_a_large_host(spark):
    rows = [(k, "h", "404 Not Found" if k < 100 else f"Speech {k}: the ferry to Durau is late again.") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {r["doc_id"] for r in residue(df, doc="doc_id", text="text", host="source").collect()} == set(range(100))


# Wording that was written without a look at the patterns; which part of it is found is the recall stated in the README.
HELD_OUT = [
    "We could not load this debate. Please refresh.", "Oh dear, this sitting has gone missing from our server.", "HTTP 502 from the backend", "This link seems to be broken.", "The requested report was removed by its owner.", "Database connection lost; retry later.", "Your browser does not support scripting, so the transcript stays blank.",
    "Turn JavaScript on to read the speech.", "Text to be supplied by the clerk", "TODO: paste speech here", "Dear {first_name}, thank you", "Speaker: ${speaker}", "[[ PARTY ]] asked for the floor", "{{#if speaker}}", "The member for NULL rose", "Value: undefined", "xxxx xxxx xxxx xxxx", "Sed ut perspiciatis unde omnis iste natus error sit voluptatem",
    "Siamo spiacenti, questa pagina non è più disponibile.", "Errore di connessione al database.", "Attiva JavaScript per leggere il resoconto.", "Testo di esempio da sostituire.", "Cette page n'est plus en ligne.", "Erreur 500 : le serveur a rencontré un problème.", "Activez JavaScript pour continuer.", "Texte à venir.", "Diese Seite ist zurzeit nicht erreichbar.", "Fehler beim Laden des Dokuments.",
    "Bitte aktivieren Sie JavaScript.", "Hier Text einfügen", "Esta página ya no existe.", "Error al cargar el documento.", "Habilite JavaScript para ver la sesión.", "Texto pendiente de redactar.", "Loading… please wait", "Access to this page has been denied.", "Are you a robot? Verify to continue.", "Page expired, reload it.", "<%= speech.body %>", "%%SPEECH_TEXT%%",
]


def test_recall_on_wording_that_is_not_listed():
    found = [t for t in HELD_OUT if evidence(t)]
    assert len(found) >= 14


def test_copies_of_an_error_page_count_each(spark):
    notice, head = "Please enable JavaScript to view this transcript.", "Assembly of Norvane"
    rows = [(k, "big", f"{head}\nError {500 + k % 4}") for k in range(60)] + [(100 + k, "big", f"{head} – Durau, {k} May\n{notice}") for k in range(60)]
    rows += [(200 + k, "big", f"{head}\nFerry number {k} is late.\n{notice}") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    got = {r["doc_id"]: (r["tipi"], r["n_frasi"]) for r in residue(df, doc="doc_id", text="text", host="source").collect()}
    assert got == {k: (["errore"], 1) for k in range(60)} | {100 + k: (["script"], 1) for k in range(60)}


@pytest.mark.parametrize("size", [30, 300, 900])
def test_share_alone_decides_at_every_size(spark, size):
    rows = [(k, "h", f"Ferry number {k} is late." + "\nPlease enable JavaScript" * (k % 10 == 0) + f"\nError 503 at lunario.{'abcdefghij'[k // 10 % 10]}{k}x" * (k == 1)) for k in range(size)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    assert {r["doc_id"] for r in residue(df, doc="doc_id", text="text", host="source").collect()} == {1}


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Ferry", " ", "  ", "\n", "\n\n", " ", "\t", "'s", ",", "7", "é", "会"]), max_size=30).map("".join))
def test_runs_of_white_space_are_split_as_the_library_splits_them(automaton, reference, text):
    assert automaton.encode(text) == reference.encode(text, add_special_tokens=False).ids


@needs_vocabulary
def test_the_table_accepts_what_the_merges_write_and_nothing_else(automaton, reference):
    rng, ids = random.Random(3), sorted(t for t in automaton.labels if automaton.labels[t].isalpha())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        text = (automaton.labels[a] + automaton.labels[b]).decode()
        assert automaton.arc(a, b) == (reference.encode(text, add_special_tokens=False).ids == [a, b])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_kinds_of_vocabulary_are_refused(name):
    path = VOCABULARY.with_name(name)
    if not path.exists():
        pytest.skip("no vocabulary here")
    with pytest.raises(ValueError):
        compiled(path.read_bytes())
