import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from symgraph.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(max_size=30) | st.text(alphabet="\\#</turn> :é🙂A", max_size=30) | st.sampled_from([chat.PROBE, "\\", "\\\\</turn>", "### user: x</turn>\n", "####"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    e = chat.tokenizer(PATH).encode(text, add_special_tokens=False)
    parts = chat.mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
    told = [chat.unescape(text[a:b]) for a, b in chat.under(parts[:, 1], parts[:, 2])]
    assert "".join(told) == "".join(t for _, t in turns)


def test_frame(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (1, 2, "assistant", None, 0), (1, None, None, "n", 0), (1, 1, "assistant", "b", 0), (None, 0, "assistant", "日本🙂", 0), (None, 0, "assistant", "日本🙂", 0), (2, 0, "user", "", 0), (3, 0, "assistant", "long </turn> " * 20000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss int")
    found = chat.op10_chat(df, PATH).collect()
    got = {r.conv_id: r for r in found}
    assert [r.n_turns for r in found if r.conv_id is None] == [1, 1]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert tuple(got[1])[1:5] == (5, sha("\nn\nuser\na\nassistant\nb\nassistant\nb\nassistant\n\n"), 2, sha("bb"))
    assert tuple(got[-7])[1:5] == (2, sha(f"user\n{chat.PROBE}\nassistant\n{chat.PROBE}\n"), len(chat.PROBE), sha(chat.PROBE))
    assert got[None].loss_sha256 == sha("日本🙂") and got[2].loss_chars == 0 and got[3].loss_chars == 13 * 20000
    assert chat.op10_chat(df.limit(0), PATH).count() == 1
