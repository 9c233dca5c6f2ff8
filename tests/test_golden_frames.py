"""All known frames of the wire format, read and, where that is stateless, written."""

from quillon.functions import control
from quillon.operators.session import Decoder, Encoder, Unsigned

# Fixed values: (stream, label, frame) of the wire format, in the order they are sent.
FRAMES = [
    ("codec", "scalar_string", "00060105616c706861"),
    ("codec", "map_two_fields_first", "02020002696404010100046e616d65060105616c696365"),
    ("codec", "map_two_fields_second", "020201000401010101060201"),
    ("codec", "map_three_fields_first", "0203010004010101010602010004726f6c6506010561646d696e"),
    ("codec", "map_three_fields_second", "0203010004010101010602010102060202"),
    ("codec", "bulk_map_0", "0202010004010a0101060106757365722d30"),
    ("codec", "bulk_map_1", "0202010004010b0101060303050131"),
    ("codec", "bulk_map_2", "0202010004010c0101060303050132"),
    ("codec", "bulk_map_3", "0202010004010d0101060303050133"),
    ("codec", "bulk_map_4", "0202010004010e0101060303050134"),
    ("codec", "bulk_map_5", "0202010004010f0101060303050135"),
    ("codec", "bulk_map_6", "020201000401100101060303050136"),
    ("codec", "bulk_map_7", "020201000401110101060303050137"),
    ("codec", "control_stream_bitpack", "0c0243018004aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"),
    ("codec", "control_stream_huffman", "0c03050101078004"),
    ("codec", "control_stream_fse", "0c049101030880040400400140024003408e808004404e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e4e"),
    ("codec", "base_snapshot", "0d4d0000030154"),
    ("session", "session_base_array", "05016405640002620100000000000000000000000000"),
    ("session", "session_patch_one_change", "0a00010001010302204e00"),
    ("session", "session_patch_iter_0", "0a00010001010302409c00"),
    ("session", "session_patch_iter_1", "0a00020001010301000101010302429c00"),
    ("session", "session_patch_iter_2", "0a00020101010301020201010302449c00"),
    ("session", "session_patch_iter_3", "0a00020201010301040301010302469c00"),
    ("session", "session_patch_many_changes", "0501640564a09c0102620f000000000000000000000000000000000000c08713c4090000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000000"),
    ("session", "session_micro_batch_first", "0b00040203020003030000020403010402e40103000000040400040161016201630164"),
    ("session", "session_micro_batch_second", "0b0004020201010300000004040004026161026262026363026464"),
]


def _values():
    """What each frame stands for, by the rules that made them."""
    yield "alpha"
    for _ in range(2):
        yield [("id", 1), ("name", "alice")]
    for _ in range(2):
        yield [("id", 1), ("name", "alice"), ("role", "admin")]
    for k in range(8):
        yield [("id", 10 + k), ("name", f"user-{k}")]
    yield bytes(k % 2 for k in range(512))
    yield bytes([7]) * 512
    yield bytes(k % 4 for k in range(512))
    yield ("scalar", 42)
    series = list(range(100))
    yield series
    yield [10_000, *series[1:]]
    for k in range(4):
        yield [20_000 + k if i == k else i for i in series]
    yield [10_000 + i if i < 12 else i for i in series]
    for names in ("abcd", ("aa", "bb", "cc", "dd")):
        yield [[i + 1, n] for i, n in enumerate(names)]


def test_every_frame_reads_as_its_value():
    readers, seen = {}, 0
    for (stream, label, frame), want in zip(FRAMES, _values(), strict=True):
        receiver, raw = readers.setdefault(stream, Decoder()), bytes.fromhex(frame)
        if label.startswith("control_stream"):
            assert receiver.receive(raw)[-1] == want, label
        elif label == "base_snapshot":
            receiver.receive(raw)
            assert receiver.state.snapshots[77] == want, label
        else:
            got = receiver.decode(raw)
            assert (list(got) if isinstance(want, list) else got) == want, label
        seen += 1
    assert seen == 26


def test_frames_are_written_as_known():
    frames = {label: frame for _, label, frame in FRAMES}
    sender, values = Encoder(), dict(zip((label for _, label, _ in FRAMES), _values()))
    assert sender.encode_value("alpha").hex() == frames["scalar_string"]
    for name, coder in (("bitpack", control.BITPACK), ("huffman", control.HUFFMAN), ("fse", control.FSE)):
        label = f"control_stream_{name}"
        assert Encoder().send(("control_stream", coder, values[label])).hex() == frames[label]
    assert Encoder().send(("snapshot", 77, 0, ("scalar", 42))).hex() == frames["base_snapshot"]
    sender = Encoder()
    assert sender.encode(values["session_base_array"]).hex() == frames["session_base_array"]
    for label in [x for x in frames if x.startswith("session_patch")]:
        assert sender.encode_patch(values[label]).hex() == frames[label], label
    for label in ("session_micro_batch_first", "session_micro_batch_second"):
        rows = [{"id": Unsigned(i), "name": n} for i, n in values[label]]
        assert sender.encode_micro_batch(rows).hex() == frames[label], label
