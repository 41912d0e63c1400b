import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointweave.llm import queries, tokens
from tests.llm.helpers import SCHEMA, collected

TEXTS = ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "no\n <|endoftext|>", "<|endoftext| >", "a  <|endoftext|>  b", "", "plain text")


@pytest.mark.parametrize("text", TEXTS)
def test_added_tokens_as_in_the_library(text):
    path = public_tokenizers.path(tokens.TOKENIZER)
    own = tokens.encoder(path, public_tokenizers.PATTERN, True)
    assert own.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_query_gives_added_tokens_their_ids(spark, tmp_path):
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    got = {r["doc_id"]: r["n_tokens"] for r in collected(queries.op5_token_shards(spark, str(tmp_path)))}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
