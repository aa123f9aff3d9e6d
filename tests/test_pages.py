"""Pages of inputs, with containers made by hand."""

import base64
import struct

import pytest

from docspark.sources import pages


def tiff(sizes, order="<", loop=False):
    """A container with a page of each (width, height), two strips each, and an odd-sized text tag."""
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    links = [4]
    for k, (w, h) in enumerate(sizes):
        strips = [bytes([k]) * (w * (h // 2)), bytes([k + 100]) * (w * (h - h // 2))]
        at = []
        for s in strips:
            at.append(len(out))
            out += s
        text = len(out)
        out += b"page %d!\0" % k
        counts = len(out)
        out += struct.pack(order + "2I", *map(len, strips))
        places = len(out)
        out += struct.pack(order + "2I", *at)
        entries = [(256, 3, 1, struct.pack(order + "HH", w, 0)), (257, 4, 1, struct.pack(order + "I", h)), (270, 2, 8, struct.pack(order + "I", text)), (273, 4, 2, struct.pack(order + "I", places)), (279, 4, 2, struct.pack(order + "I", counts))]
        begin = len(out)
        out = out[: links[-1]] + struct.pack(order + "I", begin) + out[links[-1] + 4 :]
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, y, n) + v for t, y, n, v in entries)
        links.append(len(out))
        out += struct.pack(order + "I", 0)
        if loop:
            out = out[: links[-1]] + struct.pack(order + "I", begin) + out[links[-1] + 4 :]
    return out


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"rest"


JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01\x01\x11\x00\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_a_page_of_a_container_is_a_container(order):
    sizes = [(4, 6), (3, 5), (10, 2)]
    found = list(pages.pages_of(tiff(sizes, order)))
    assert [(f, w, h) for f, w, h, _ in found] == [("tiff", w, h) for w, h in sizes]
    for k, (_, w, h, content) in enumerate(found):
        [(kind, *size, again)] = pages.pages_of(content)
        assert (kind, size, again) == ("tiff", [w, h], content)
        [tags] = pages.tiff_directories(content)
        assert tags[270][2] == b"page %d!\0" % k
        data = b"".join(content[a : a + n] for a, n in zip(pages.tiff_numbers(order, tags[273]), pages.tiff_numbers(order, tags[279])))
        assert data == bytes([k]) * (w * (h // 2)) + bytes([k + 100]) * (w * (h - h // 2))
    assert len(list(pages.pages_of(tiff(sizes, order), 2))) == 2
    assert len(list(pages.pages_of(tiff([(2, 2)], order, loop=True)))) == 1


def test_units(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.tif").write_bytes(tiff([(4, 6), (3, 5)]))
    (tmp_path / "in" / "deep" / "b.png").write_bytes(png(8, 5))
    (tmp_path / "in" / "c.jpg").write_bytes(JPEG)
    (tmp_path / "in" / "bad.tif").write_bytes(tiff([(4, 6)])[:30])
    (tmp_path / "in" / "text.txt").write_bytes(b"no image")
    root = f"{tmp_path}/in"
    uri = "data:image/png;base64," + base64.b64encode(png(2, 3)).decode()
    gif = "data:image/gif;base64," + base64.b64encode(b"GIF89a" + struct.pack("<HH", 6, 4)).decode()
    sources = [f"file://{root}/a.tif", f"{root}/deep/b.png", uri, f"{root}/c.jpg", f"{root}/a.tif", f"{root}/nowhere.png", f"{root}/bad.tif", None, gif, "data:image/png;base64,!!", f"{root}/text.txt"]
    got = [(r.unit, r.page, r.format, r.width, r.height, r.error is None) for r in pages.read_units(spark, sources, root).orderBy("unit", "page").collect()]
    assert got == [
        (0, 0, "tiff", 4, 6, True), (0, 1, "tiff", 3, 5, True), (1, 0, "png", 8, 5, True), (2, 0, "png", 2, 3, True), (3, 0, "jpeg", 9, 7, True), (4, 0, "tiff", 4, 6, True), (4, 1, "tiff", 3, 5, True),
        (5, 0, None, None, None, False), (6, 0, None, None, None, False), (7, 0, None, None, None, False), (8, 0, "gif", 6, 4, True), (9, 0, None, None, None, False), (10, 0, None, None, None, False),
    ]
    assert pages.read_units(spark, sources[:1], root, most=1).count() == 1
