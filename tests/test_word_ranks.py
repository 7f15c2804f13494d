import public_tokenizers
from tokenizers import Tokenizer

from siltmark.llm.tokens import WordRankEncoder, id_bytes, library_encoder, read_definition


def test_word_vocabulary_is_encoded_by_ranks_as_the_library_does():
    source = read_definition(public_tokenizers.path("word_bpe_49k.json"))
    encoder, library = library_encoder(source), Tokenizer.from_str(source)
    assert isinstance(encoder, WordRankEncoder)
    texts = [
        "", " ", "\n\t", "It's WE'LL stpfzu.\nÄtz 1234 a-b", "a\0b \0", "ΟΔΟΣ ΣΑΣ", "İstanbul", "x\x1cy\x85z\u180ew", "e\u0301té", "<|endoftext|> a",
        "中文日本 हिन्दी 👍🏽 ½²", "a" * 3000, " " * 6000 + "b", "enberenlich Enberenlich ENBERENLICH'S",
    ]
    for text in texts:
        assert encoder(text) == id_bytes(library.encode(text, add_special_tokens=False).ids), text
