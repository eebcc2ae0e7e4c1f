import random
import re
import time

import numpy as np
import pytest

from driftwarden.llm import private
from driftwarden.llm.private_query import op13_private_data

FORMS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == private.IP:
        return all(int(x) <= 255 for x in span.split("."))
    if kind == private.CARD:
        return 16 <= len(digits) <= 19 and private.luhn(digits)
    return kind == private.EMAIL or 8 <= len(digits) <= 15


def plain(text):
    return [(k, *m.span()) for k, form in enumerate(FORMS, 1) for m in re.finditer(form, text or "") if holds(k, m.group())]


@pytest.mark.parametrize("signs", ["ab@@..1", "0123456789  --", "+12 ().-", "1.2.345", "a1@.-+ é(\n"])
def test_base_spans_against_the_plain_patterns(signs):
    rng = random.Random(len(signs))
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert private.base_spans(text) == plain(text)


def test_base_spans_in_prose():
    text = "é a.b@c.de@f.gh x@y 1.2.3.4.5.6.7.8 300.1.1.1, 4111 1111-1111 1111, 4111111111111112, +1 (988) 555-2485. +123 +12345678901234567"
    assert private.base_spans(text) == plain(text)
    assert [k for k, *_ in private.base_spans(text)] == [1, 2, 2, 3, 4]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "@", "a@", "+1", "1 ", "(1", "a.", "1-", "@a."])
def test_long_texts_take_time_in_proportion(unit):
    text = unit * (400_000 // len(unit))
    started = time.process_time()
    private.base_spans(text)
    private.loose_spans(text)
    assert time.process_time() - started < 20


def test_aggregation_finds_the_reliable_labelers():
    rng = np.random.default_rng(1)
    truth = rng.choice(5, 20_000, p=[0.5, 0.1, 0.1, 0.15, 0.15])
    share = [0.95, 0.9, 0.6]
    cast = np.stack([np.where(rng.random(len(truth)) < p, truth, rng.integers(0, 5, len(truth))) for p in share], 1)
    cast[rng.random(cast.shape) < 0.2] = private.ABSTAIN
    sure, right = private.aggregated(cast, np.ones(len(truth)))
    found = [float(np.diagonal(right[k]).mean()) for k in range(3)]
    assert found == pytest.approx([p + (1 - p) / 5 for p in share], abs=0.03)
    told = (cast != private.ABSTAIN).any(1)
    assert (sure.argmax(1) == truth)[told].mean() > 0.9


def corpus(spark):
    rng = random.Random(6)
    words = "the river was long and they walked along it for days".split()

    def some(n=6):
        return " ".join(rng.choice(words) for _ in range(n))

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    def card(prefix, n):
        while not private.luhn(made := prefix + number(n - len(prefix))):
            pass
        return made

    rows, want = [], {}

    def add(before, span, kind, after=" "):
        left = f"{some()} {before}"
        rows.append((len(rows), f"{left}{span}{after}{some()}", "x", 1))
        want[len(rows) - 1] = {(kind, len(left), len(left) + len(span))} if kind else set()

    for _ in range(60):
        add("", f"{rng.choice(words)}.{number(2)}@mail.example.com", private.EMAIL)
        add("", f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", private.IP)
        add("card ", card("4", 16), private.CARD)
        add("call ", f"+1 ({number(3)}) 555-{number(4)}", private.PHONE)
        add("tel ", f"({number(3)}) 555-{number(4)}", private.PHONE)
        add("mail ", f"{rng.choice(words)} [at] example [dot] com", private.EMAIL)
        add("card ", card("37", 15), private.CARD)
        add("order ", number(5), None)
        add("", f"{rng.randrange(1900, 2030)}", None)
        add("", f"{rng.randrange(10)}.{rng.randrange(10)}", None)
        add("token=", f"a{number(16)}f{number(3)}", None, "c ")
        add("in ", f"2024-0{rng.randrange(1, 9)}-1{rng.randrange(9)}", None)
        add("version ", f"{rng.randrange(300, 999)}.{rng.randrange(999)}.{rng.randrange(999)}.{rng.randrange(999)}", None)
    rows += [(None, "a@b.cd", "x", 1), (5, None, "x", 1), (5, "", "x", 1), (7, "x " * 50_000 + "a@b.cd", "x", 1), (7, "x " * 50_000 + "a@b.cd", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, spans int").repartition(3), rows, want


def test_looser_forms_are_added_and_others_left_alone(spark):
    docs, rows, want = corpus(spark)
    got = [(r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in private.find(docs).collect()]
    assert sorted((str(i), base) for i, base, _ in got) == sorted((str(r[0]), plain(r[1])) for r in rows)
    assert all(set(base) <= set(spans) and spans == sorted(spans) for _, base, spans in got)
    found = {i: set(spans) for i, _, spans in got if i in want and i not in (5, 7, None)}
    caught = sum(want[i] <= spans for i, spans in found.items() if want[i])
    clean = sum(not spans for i, spans in found.items() if not want[i])
    assert caught / sum(bool(want[i]) for i in found) > 0.95
    assert clean / sum(not want[i] for i in found) > 0.98


def test_neighbours_do_not_hide_each_other(spark):
    docs, *_ = corpus(spark)
    text = "so +1 (269) 555-3296 4524132264652876 and 7 4111111111111111 or +1 (578) 555-6437 95.148.107.251 it"
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, text)], "doc_id long, text string"))
    base, spans = private.find(docs).where("doc_id = -1").select("base", "spans").first()
    assert [text[s.start : s.end] for s in base] == ["95.148.107.251"]
    assert [text[s.start : s.end] for s in spans] == [
        "95.148.107.251", "4524132264652876", "4111111111111111", "+1 (269) 555-3296", "+1 (578) 555-6437"
    ]


def test_no_rows(spark, no_documents):
    assert private.find(no_documents).count() == 0
    assert private.learned(np.zeros(0, np.int64), np.zeros(0, np.int64)).kinds == {}


def test_query(spark, sha):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op13_private_data(spark, folder).collect()
    assert len(got) == len(texts)
    for row in got:
        spans = plain(texts[row.doc_id])
        told = [f"{private.KINDS[k - 1]}:{a}:{b}" for k, a, b in spans]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in (1, 2, 3, 4)]
        assert row.base_sha256 == sha(",".join(told))
        assert set(told) <= set(row.spans.split(",")) | ({""} if not told else set())
