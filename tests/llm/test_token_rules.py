"""A tokenizer whose rules differ from the ones that may be applied word by word: the library's ids all the same."""

import copy
import json

import pyarrow as pa
import pytest

from seqlens.llm import token_file
from seqlens.llm.registry import tokenizer_path

TEXTS = ["Hello World, it's HERE\n\n and  there's É 42", "", "ÀB ǅ x_y don't", " lead and trail "]


def variants():
    with open(tokenizer_path(), encoding="utf-8") as f:
        whole = json.load(f)
    for one, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        parts = whole[one][many]
        for i in range(len(parts)):
            less = copy.deepcopy(whole)
            del less[one][many][i]
            yield f"without {parts[i]['type']}", less
        turned = copy.deepcopy(whole)
        turned[one][many].reverse()
        yield f"{many} in another order", turned
        none = copy.deepcopy(whole)
        none[one] = None
        yield f"without {one}", none


@pytest.mark.parametrize(("name", "rules"), list(variants()))
def test_ids_are_the_library_s(tmp_path, name, rules):
    from tokenizers import Tokenizer

    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(rules))
    encoder, tokenizer = token_file.Encoder(str(path)), Tokenizer.from_file(str(path))
    assert not encoder.by_word
    ids, off = encoder.texts(pa.array(TEXTS, pa.large_string()))
    for i, text in enumerate(TEXTS):
        assert ids[off[i] : off[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, name
