import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pointweave.llm import tokens
from tests.llm.helpers import words


def own():
    return tokens.LibraryBPE(public_tokenizers.path(tokens.TOKENIZER), public_tokenizers.PATTERN, True)


ENCODER, LIBRARY = own(), Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
PIECES = st.sampled_from([*" \n\t\rab1!é　\x1c\x85\xa0'sß😀ſ²-.,;", "  ", " the", "s. ", "<|endoftext|>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(PIECES, max_size=20).map("".join), max_size=8))
def test_many_texts_as_in_the_library(texts):
    got = ENCODER.encode_all(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_part_of_a_batch():
    texts = pa.array(["first one", None, "", "  two. ", "three<|endoftext|>"])
    whole = [x.tolist() for x in ENCODER.encode_all(texts)]
    assert [x.tolist() for at in range(5) for x in ENCODER.encode_all(texts.slice(at, 1))] == whole


def test_a_word_is_looked_up_once_for_many_texts_and_kept_without_its_marks():
    encoder, asked = own(), []
    made = encoder.texts.word.make
    encoder.texts.word.make = lambda w: asked.append(w) or made(w)
    lookups, by_word = [], encoder.texts._word_with_marks
    encoder.texts._word_with_marks = lambda w: lookups.append(w) or by_word(w)
    text = "\n".join([words(50, 1), *[" ".join(["sentence", "sentence.", "sentence,"] * 300)] * 20])
    got = encoder.encode_all(pa.array([text] * 3))
    assert [x.tolist() for x in got] == [LIBRARY.encode(text, add_special_tokens=False).ids] * 3
    assert len(lookups) == len(set(lookups)) == len(set(text.split(" ")))
    assert asked.count("sentence") == 1 and not {"sentence.", "sentence,"} & {*asked, *encoder.texts.word}


def test_shards_do_not_depend_on_how_texts_are_taken_together(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, f"{words(40, i)}.\n {words(9, i)}" if i % 5 else None) for i in range(60)], "doc_id bigint, text string")
    ids = []
    for i, most in enumerate((1, 500, 1 << 23)):
        monkeypatch.setattr(tokens, "TEXT_BYTES", most)
        tokens.write(rows, f"{tmp_path}/{i}", partitions=2)
        ids.append(sorted((r["start"], r["doc_id"], *r["ids"]) for r in tokens.read(spark, f"{tmp_path}/{i}").collect()))
    assert ids[0] == ids[1] == ids[2] and len(ids[0]) == 60


def test_long_texts_stay_out_of_the_common_arrays(monkeypatch):
    monkeypatch.setattr(tokens, "TEXT_BYTES", 1000)
    encoder, taken = own(), []
    by_word = encoder.texts._word_with_marks
    encoder.texts._word_with_marks = lambda w: taken.append(w) or by_word(w)
    texts = ["x y. " * 201 + "end", " " * 900 + "z", "one two"]  # too long; not every space a cut; plain
    assert [x.tolist() for x in encoder.encode_all(pa.array(texts))] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert {*taken} <= {"", "one", "two"}
