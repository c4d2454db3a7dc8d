import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, chat

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CODEC = bpe.codec(VOCABULARY, PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=4))
def test_encoding_equals_reference(texts):
    for t, packed in zip(texts, CODEC.encode_batch(texts), strict=True):
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == REFERENCE.encode_ordinary(t)
        assert CODEC.decode(packed) == t.encode()


def test_overlapping_and_long_pieces():
    for t in ("a" * 3001, "ab" * 2000, "aaab" * 50, "\n" * 33, "é" * 777):
        assert list(memoryview(CODEC.encode_batch([t])[0]).cast("I")) == REFERENCE.encode_ordinary(t)


def test_encode_table(odd, nothing):
    got = bpe.encode(odd, VOCABULARY, PATTERN).collect()
    assert len(got) == odd.count()
    texts = {(r.doc_id, r.text or "") for r in odd.collect()}
    digests = {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in texts}
    assert {(r.doc_id, r.decoded_sha256) for r in got} == digests
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.encode(nothing, VOCABULARY, PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/\\[]sINTSYROLEND x", max_size=60))
def test_escape_round_trip(text):
    marked = chat.escape_control(text)
    assert chat.unescape_control(marked) == text
    assert not any(c in marked for c in chat.CONTROL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.text(alphabet="<>/\\[]sINTSYROLEND \n", max_size=30)), max_size=6))
def test_conversation_round_trip(turns):
    render = chat.compile_template(chat.DEFAULT_TEMPLATE)
    text, spans = render(messages=[{"role": r, "text": t} for r, t in turns])
    assert chat.read_back(text) == turns
    assert [chat.unescape_control(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    t = "{% set k = 'a' ~ 1 %}{% for x in xs %}{% if loop.first %}[{% elif x.n > 2 and not x.hide %}+{% else %},{% endif %}{{ x.n }}{% endfor %}{{ k | upper }}"
    assert chat.compile_template(t)(xs=[{"n": 1, "hide": False}, {"n": 3, "hide": False}, {"n": 4, "hide": True}])[0] == "[1+3,4A1"
    folded = chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}"))
    assert folded == (chat.Output(chat.Const("abcd")),)
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ x | open }}", "{% if x %}", "{{ f() }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ secret }}")(x=1)


def test_format_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "</s>"), (2, 0, None, "</s>"), (None, 0, "user", "q"), (3, None, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 2, None: 1, 3: 1}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n").hexdigest()
    assert got[1].loss_chars == 1 and got[2].loss_chars == 0
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_not_binds_looser_than_comparisons_and_hyphens_trim():
    show = lambda source, **v: chat.compile_template(source)(**v)[0]
    assert show("{% if not a == b %}x{% else %}y{% endif %}", a=1, b=2) == "x"
    assert show("{% if not a == b %}x{% else %}y{% endif %}", a=1, b=1) == "y"
    assert show("{% if not not a and not b < c %}x{% endif %}", a=1, b=3, c=2) == "x"
    assert show("{% if not (a or b) %}x{% endif %}", a=0, b=0) == "x"
    assert show("a \n {%- set x = 'q' -%} \n b {{- x -}}  c {{ x }} d", ) == "abqc q d"
    assert chat.compile_template("{%- generation -%} {{ t }} {%- endgeneration -%} z")(t=" k ") == (" k z", [(0, 3)])


def test_long_conversation_and_clashing_columns(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} </s> ") for i in range(4000)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for name in ("formatted", "spans", "turns", "messages"):
        df = df.withColumn(name, df.turn)
    got = {r.conv_id: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    assert got[1].n_turns == 4000 and got[2].n_turns == 1
    loss = "".join(r[3] for r in rows if r[2] == "assistant")
    assert got[1].loss_chars == len(loss) and got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
