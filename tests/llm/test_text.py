"""Chat formatting and BPE against plain versions and round trips."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.bpe import ByteBPE, bpe_round_trip
from gridloom.llm.chat import DEFAULT, ChatTemplate, Formatter, Turn, chat_digests, format_chats

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def models():
    return ByteBPE(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "<s>"]), st.lists(st.sampled_from([*DEFAULT.controls(), "\\", "<", "[", "a", "\n", "/"]), max_size=8).map("".join)), max_size=6))
def test_chat_round_trip(turns):
    f = Formatter()
    segments, _ = f.segments(turns)
    text = "".join(t for t, _ in segments)
    assert f.read_back(text) == turns
    assert "".join(f.unescape(t) for t, loss in segments if loss) == "".join(t for r, t in turns if r == "assistant")
    inside = [t for k, (t, _) in enumerate(segments) if k % 3 == 1]
    assert not any(c in t for t in inside for c in DEFAULT.controls())


def test_chat_states():
    valid = lambda *roles: Formatter().segments([(r, "x") for r in roles])[1] is None
    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not any([valid(), valid("user"), valid("assistant"), valid("user", "user", "assistant"), valid("user", "system"), valid("tool")])


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", None), (2, None, None, "z"), (None, 0, "user", "q"), (3, 0, "user", "x" * 200_000), (4, 0, "user", "s"), (4, 0, "user", "s")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in format_chats(df).collect()}
    assert got[1]["formatted"] == "[INST]a[/INST]<s>b</s>" and got[1]["valid"] and got[4]["n_turns"] == 2
    assert got[2]["formatted"].endswith("[INST][/INST]") and not got[2]["valid"] and len(got) == 5
    digest = {r["conv_id"]: r for r in chat_digests(format_chats(df)).collect()}
    assert digest[1]["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and digest[1]["loss_chars"] == 1
    assert format_chats(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_bpe_any_text(models, text):
    mine, theirs = models
    ids = mine.encode_batch([text])[0]
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want and mine.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_words(models):
    mine, theirs = models
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc the'sll ré\n\t\x1c 漢😀09.,<|endoftext|>½") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["", "x" * 9000, "ab" * 4000, " " * 500, "a<|endoftext|><|endoftext|> b"]
    small = ByteBPE(PATH, short=5, cache=10)
    for model in (mine, small):
        for part in (texts[:100], texts[100:]):
            got = model.encode_batch(part)
            assert [x.tolist() for x in got] == [e.ids for e in theirs.encode_batch(part, add_special_tokens=False)]
            assert [model.decode(x) for x in got] == part


def test_bpe_broken_bytes(models):
    mine, theirs = models
    for ids in ([447], [255, 30], [50256, 188]):
        assert mine.decode(__import__("numpy").array(ids)) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    df = spark.createDataFrame([(1, None, "q"), (None, "abc", "q"), (2, "a b", "q"), (2, "a b", "q")], "doc_id bigint, text string, ids string")
    got = sorted(bpe_round_trip(df, PATH, keep_ids=True).collect(), key=str)
    assert len(got) == 4 and {r["doc_id"]: r["n_tokens"] for r in got} == {1: 0, None: 1, 2: 2}
    assert all(r["decoded_sha256"] == hashlib.sha256({1: b"", None: b"abc", 2: b"a b"}[r["doc_id"]]).hexdigest() for r in got)
    assert bpe_round_trip(df.limit(0), PATH).count() == 0


def test_templates_that_cannot_be_read_back_are_refused():
    for turns in ({"user": Turn("<u>", "###")}, {"user": Turn("<u", "</u>"), "assistant": Turn("<ut", "</a>")}, {"user": Turn("<u>", "</u>"), "assistant": Turn("<u>", "</a>")}, {"user": Turn("<", "</u>")}):
        with pytest.raises(ValueError):
            Formatter(ChatTemplate(turns=turns))
    for hostile in ("##", "<", "</", "</s", "\\", "\\\\<", "<\\/s>"):
        turns = [("user", hostile), ("assistant", hostile), (hostile, hostile)]
        fmt = Formatter(ChatTemplate(turns={"user": Turn("<u>", "##!"), "assistant": Turn("<s>", "</s>", loss=True)}))
        assert fmt.read_back("".join(t for t, _ in fmt.segments(turns)[0])) == turns
