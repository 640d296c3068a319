"""Decontamination of items rich in placeholders, of changed names and of changed case."""

import pyarrow as pa
import pytest

from folium.llm import decontamination as D
from tests.llm.test_near_and_leaks import leaks

DENSE = ["Compute 12 + 35 * 4 - 7 + 19 * 3 - 6", "List the Primes 2, 3, 5, 7, 11, 13, 17, 19, 23", "3 + 4 * 5 = ?", "The Old Man And The Sea By Ernest Hemingway"]


@pytest.mark.parametrize("options", [{}, {"max_shipped": 40}])
def test_dense_items_match_as_copies(spark, options):
    texts = [f"so it began . {item} and then it went on" for item in DENSE]
    others = ["Compute 12 + 35 * 4 - 8 + 19 * 3 - 6", "List the Primes 29, 31, 37, 41, 43, 47, 53, 59, 61", "the numbers 3 4 5 and 13 + 4 * 5"]
    assert set(leaks(spark, texts + others, DENSE, **options)) == {(k, k) for k in range(len(DENSE))}


@pytest.mark.parametrize("options", [{}, {"max_shipped": 40}])
def test_lower_case_copy(spark, options):
    item = "Der alte Mann ging mit seinem Hund durch den Wald zum Markt und kaufte Brot und Milch"
    assert set(leaks(spark, ["er las: " + item.lower() + " so", item.upper(), "etwas anderes ganz ohne Bezug"], [item], **options)) == {(0, 0), (1, 0)}


def test_reader_knows_names_and_values():
    texts = ["The 5kg bag, and Bob Smith paid 3.5 km to 20 dollars. The Cat | sat; Then 5 m", "", None, "x 10 kg. Kg 5 5kg Mm "]
    *_, loose, fixed, exact, offsets = D.Reader().readings(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        part = slice(offsets[k], offsets[k + 1])
        words, values = D.templates(text or "", True)
        assert [D._hash(w) for w in words] == loose[part].tolist() and [w[0] != "<" for w in words] == fixed[part].tolist()
        assert [D._hash(v) for v in values] == exact[part].tolist()


MARY = "Mary has 12 eggs and 3 pans. Mary sells 5 eggs. Mary buys 4 pans. How many pans does Mary own?"


@pytest.mark.parametrize("options", [{}, {"max_shipped": 40}])
def test_names_that_begin_sentences(spark, options):
    other = MARY.replace("Mary", "Peter").replace("12", "31").replace("3 pans", "8 pans").replace("5", "6").replace("4", "9")
    mixed = "Ann has 12 eggs and 3 pans. Bob sells 5 eggs. Cid buys 4 pans. How many pans does Dan own?"
    got = leaks(spark, ["He asked. " + other + " Then he left.", mixed, "Mary has eggs and pans of her own to sell"], [MARY], **options)
    assert set(got) == {(0, 0)} and got[0, 0]["coverage"] > 0.8 and got[0, 0]["reparameterised"]
