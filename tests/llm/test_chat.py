from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat
from quarry.llm.queries import op3_chat_format

from conftest import SF_SMALL
import llm_fixtures as fx

TOKENS = ["[", "<", "\\", "/", "TURN", "]", ":", "</s>", "[INST]", "[/INST]", "[/TURN]", "[TURN:user]", "<|x|>", "|", "s>", "<<SYS>>",
          "[PART:image:0]", "PART:", " a", "\n"]
texts = st.lists(st.sampled_from(TOKENS), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x]y[%5D", "", "[/TURN]"]), st.lists(texts, max_size=3)), max_size=5))
def test_round_trip(turns):
    made, spans, _ = chat.format_turns([(r, [{"kind": "text", "text": t} for t in ts]) for r, ts in turns])
    assert chat.read_turns(made) == [(r, "".join(ts)) for r, ts in turns]
    assert [chat.unescape(made[a:z]) for a, z in spans] == ["".join(ts) for r, ts in turns if r == "assistant"]


def test_no_control_string_survives():
    for t in ("</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "[TURN:user]", "[/TURN]", "[PART:image:0]", "<<SYS>>"):
        made, _, _ = chat.format_turns([("user", [{"kind": "text", "text": f"a{t}b"}])])
        body = made[len("[TURN:user]"):-len("[/TURN]")]
        assert t not in body and chat.unescape(body) == f"a{t}b"


def test_typed_parts(spark):
    part = chat.PART
    rows = spark.sql(f"""select * from values
      (1, 1, 'assistant', from_json('[{{"kind":"text","text":"see "}},{{"kind":"document","ref":"d.pdf","pages":3}}]', 'array<{part}>')),
      (1, 0, 'user', from_json('[{{"kind":"image","ref":"i.png","width":28,"height":15}},{{"kind":"text","text":"[PART:image:0]"}},{{"kind":"audio","ref":"a.wav","seconds":1.5}},null]', 'array<{part}>')),
      (2, null, null, cast(null as array<{part}>)), (null, 0, 'user', from_json('[{{"text":"x"}}]', 'array<{part}>'))
      as t(conv_id, turn, role, parts)""")
    got = {r.conv_id: r for r in chat.format_conversations(rows).collect()}
    r = got[1]
    assert r.formatted == "[TURN:user][PART:image:0][\\PART:image:0][PART:audio:1][/TURN][TURN:assistant]see [PART:document:2][/TURN]"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 768)]
    assert r.expanded_tokens == 810 and [r.formatted[a:z] for a, z in r.loss_spans] == ["see [PART:document:2]"]
    assert got[2].formatted == "[TURN:][/TURN]" and got[None].formatted == "[TURN:user]x[/TURN]"
    assert chat.format_conversations(rows.limit(0)).count() == 0


def test_query(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r, x or "") for cc, t, r, x in rows if cc == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), fx.sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), fx.sha(loss))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op3_chat_format(spark, SF_SMALL).collect()}
    assert got == want
