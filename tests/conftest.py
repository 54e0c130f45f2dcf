import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lexiflow.session import local_session
    s = local_session(4, shuffle_partitions=8, app="lexiflow-tests")
    yield s


@pytest.fixture(scope="session")
def four_docs(spark):
    return spark.createDataFrame(
        [(1, "This is a text.", "a"), (2, "This is another one.", "b"),
         (3, "And this is yet another text", "a"), (4, "The house is really nice", None)],
        "doc_id long, text string, grp string")


@pytest.fixture(scope="session")
def parsed3(spark):
    rows = []
    docs = {1: [("The", "the", "DET"), ("dog", "dog", "NOUN"), ("is", "be", "AUX"), ("in", "in", "ADP"),
                ("the", "the", "DET"), ("kitchen", "kitchen", "NOUN"), (".", ".", "PUNCT")],
            2: [("No", "no", "INTJ")],
            3: [("The", "the", "DET"), ("cat", "cat", "NOUN"), ("is", "be", "AUX"),
                ("sleeping", "sleep", "VERB"), ("!", "!", "PUNCT")]}
    for d, toks in docs.items():
        for i, (t, lem, pos) in enumerate(toks, start=1):
            rows.append((d, i, t, lem, pos))
    return spark.createDataFrame(rows, "doc_id long, token_id int, token string, lemma string, upos string")
