import re

from driftwarden.llm import exact


def expected(prose):
    body = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in prose}
    groups = {}
    for i, t in prose:
        groups.setdefault(body[i], []).append((-len(t or ""), i))
    best = {k: min(v)[1] for k, v in groups.items()}
    return {i: (best[b], len(groups[b]), best[b] == i) for i, b in body.items()}


def answer(frame):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in frame.collect()}


def test_groups_against_brute_force(documents, prose):
    assert answer(exact.exact_dedup(documents)) == expected(prose)


def test_any_digits_give_the_same_groups(documents, prose):
    assert answer(exact.exact_dedup(documents, first_digit=1, growth=3, widest=700)) == expected(prose)


def test_drop_copies_keeps_columns_and_one_of_each(documents, prose):
    left = exact.drop_copies(documents)
    assert left.columns == documents.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, x in expected(prose).items() if x[2])


def test_repeated_rows_missing_ids_and_no_rows(spark, no_documents):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab"), (None, "ab"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, exact.exact_dedup(rows).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (1, 1, 3, True), (2, 1, 3, False), (None, None, 1, True), (3, 3, 1, True)], key=str)
    assert exact.exact_dedup(no_documents).count() == 0
    assert exact.drop_copies(no_documents).count() == 0


def test_different_texts_under_one_id_are_documents_of_their_own(spark):
    rows = [(3, "same text here"), (5, "same text here"), (5, "a unique one"), (5, "p" * 40 + "x"), (7, "p" * 40 + "x"), (5, "p" * 40 + "y"), (9, "p" * 40 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact.drop_copies(docs).collect())) == sorted(
        [(3, "same text here"), (5, "a unique one"), (5, "p" * 40 + "x"), (5, "p" * 40 + "y")]
    )
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(docs).collect())
    assert got == sorted([(3, 3, 2, True), (5, 3, 2, False), (5, 5, 1, True), (5, 5, 2, True), (7, 5, 2, False), (5, 5, 2, True), (9, 5, 2, False)])
