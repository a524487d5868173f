import numpy as np
import pytest

from argentic.operators import palette, qr, raster
from argentic.plans import queries
from argentic.plans.queries import write_exif_jpeg, write_flat_jpeg, write_gif
from argentic.sources import exif, folder, gif, jpeg, png

RNG = np.random.default_rng(3)


def photo(h, w):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // w, y * 255 // h, (x + y) * 255 // (w + h)], axis=2).astype(np.uint8)


def scene():
    """Smooth blobs: enough to tell apart, and the same at any size."""
    return raster.resize(np.random.default_rng(8).integers(0, 256, (6, 9, 3)).astype(np.uint8), 270, 180)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (40, 33)])
def test_png_round_trip(shape):
    px = RNG.integers(0, 256, (*shape, 3)).astype(np.uint8)
    assert (png.decode(png.encode(px)) == px).all()


def test_broken_images_raise_only_their_error():
    files = [png.encode(photo(9, 9)), write_gif(RNG.integers(0, 256, (9, 9)), np.zeros((256, 3))), write_flat_jpeg(RNG.integers(0, 256, (3, 3)))]
    for decoder, data in zip((png, gif, jpeg), files, strict=True):
        for k in range(0, len(data), 3):
            broken = bytearray(data)
            broken[k] ^= 0x55
            for bad in (data[:k], bytes(broken)):
                try:
                    decoder.decode(bad)
                except png.ImageError:
                    pass


def test_inflate_is_bounded():
    import zlib

    with pytest.raises(png.ImageError):
        png.inflate(zlib.compress(bytes(10_000_000)), 1000)


def test_orientations_undo_each_other():
    px = photo(4, 6)
    for k, back in {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 8, 7: 7, 8: 6}.items():
        assert (raster.orient(raster.orient(px, k), back) == px).all()


@pytest.mark.parametrize("size,wanted", [((1000, 500), (256, 128)), ((500, 1000), (128, 256)), ((100, 80), (100, 80))])
def test_fit(size, wanted):
    assert raster.fit(*size) == wanted


def test_luma():
    assert raster.luma(np.array([[255, 255, 255], [255, 0, 0], [0, 255, 0]], dtype=np.uint8)).tolist() == [255, 76, 149]


def test_hash_survives_scaling_and_turning():
    px = scene()
    _, a, turned = raster.signature(px)
    _, b, _ = raster.signature(raster.resize(px, 135, 90))
    _, c, _ = raster.signature(np.rot90(px, -1))
    assert (a ^ b).bit_count() <= 4
    assert min((t ^ c).bit_count() for t in turned) <= 10


def test_palettes():
    few = RNG.integers(0, 4, (9, 9, 3)).astype(np.uint8) * 80
    colours, index, exact = palette.quantise(few)
    assert exact and (colours[index] == few).all()
    many = photo(64, 64)
    colours, index, exact = palette.quantise(many)
    assert not exact and len(colours) <= 256
    assert np.abs(colours[index].astype(int) - many).mean() < 8
    assert png.decode(palette.encode_thumbnail(many)).shape == many.shape


def test_exif():
    for order in "<>":
        found = exif.parse(write_exif_jpeg("Canon", "2024:05:06 07:08:09", 6, order))
        assert (found["make"], found["modified"], found["orientation"]) == ("Canon", "2024:05:06 07:08:09", 6)
    data = write_exif_jpeg("Canon", "2024:05:06 07:08:09", 6)
    for k in range(len(data)):
        exif.parse(data[:k])
    assert exif.parse(b"")["make"] is None


def test_qr():
    m = qr.encode(b"https://photos.example:8443/a")
    assert m.shape == (29, 29) and qr.encode(b"x" * 60).shape == (33, 33) and qr.encode(b"x" * 200) is None
    assert qr.generator(7) == (1, 127, 122, 154, 164, 11, 68, 117)
    words = qr.codewords(b"hello", 55, 15)
    assert len(words) == 70
    for root in range(15):  # a codeword is zero at the generator's roots
        x, total = qr._field()[0][root], 0
        for w in words:
            total = qr.multiply(total, x) ^ w
        assert total == 0
    assert qr.raster(m, 2).shape == (74, 74, 3)


def test_qr_reads_back():
    """A plain reader: format from the modules, mask undone, bytes along the columns, check words zero at the generator's roots."""
    masks = [lambda i, j: (i + j) % 2, lambda i, j: i % 2, lambda i, j: j % 3, lambda i, j: (i + j) % 3, lambda i, j: (i // 2 + j // 3) % 2,
             lambda i, j: i * j % 2 + i * j % 3, lambda i, j: (i * j % 2 + i * j % 3) % 2, lambda i, j: ((i + j) % 2 + i * j % 3) % 2]
    for text in (b"a", b"file:///home/x/pictures/2024", b"q" * 50, b"long one " * 8):
        m = qr.encode(text)
        n = len(m)
        version = (n - 17) // 4
        places = [(8, x) for x in (0, 1, 2, 3, 4, 5, 7, 8)] + [(y, 8) for y in (7, 5, 4, 3, 2, 1, 0)]
        word = int("".join(str(int(m[p])) for p in places), 2) ^ 0x5412
        level, k = word >> 13, word >> 10 & 7
        assert level == 1
        taken = np.zeros((n, n), dtype=bool)
        taken[:9, :9] = taken[:9, n - 8 :] = taken[n - 8 :, :9] = taken[6] = taken[:, 6] = True
        taken[n - 9 : n - 4, n - 9 : n - 4] = True
        bits, up = [], True
        for right in [c for c in range(n - 1, 6, -2)] + [5, 3, 1]:
            for y in range(n - 1, -1, -1) if up else range(n):
                bits += [int(m[y, x]) ^ (masks[k](y, x) == 0) for x in (right, right - 1) if not taken[y, x]]
            up = not up
        data = [int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits) - 7, 8)]
        words, checks = {3: (55, 15), 4: (80, 20)}[version]
        stream = "".join(f"{v:08b}" for v in data[:words])
        size = int(stream[4:12], 2)
        assert stream[:4] == "0100" and bytes(int(stream[12 + 8 * i : 20 + 8 * i], 2) for i in range(size)) == text

        def times(a, b):
            out = 0
            while b:
                out ^= a * (b & 1)
                a, b = a << 1 ^ 0x11D * (a >> 7), b >> 1
            return out

        root = 1
        for _ in range(checks):
            total = 0
            for v in data[: words + checks]:
                total = times(total, root) ^ v
            assert total == 0
            root = times(root, 2)


def test_phash_by_plain_cosines():
    rng = np.random.default_rng(2)
    for _ in range(5):
        g = raster.resize(rng.integers(0, 256, (5, 7)).astype(np.uint8), 32, 32).astype(float)
        scale = lambda u: (1 / 32) ** 0.5 if u == 0 else (2 / 32) ** 0.5
        wave = [[scale(u) * np.cos((2 * x + 1) * u * np.pi / 64) for x in range(32)] for u in range(8)]
        values = [sum(g[y, x] * wave[v][y] * wave[u][x] for y in range(32) for x in range(32)) for v in range(8) for u in range(8)][1:]
        middle = sorted(values)[31]
        bits = raster.phash_grid(g.astype(np.uint8))
        assert all((bits >> i & 1) == (v > middle) for i, v in enumerate(values) if abs(v - middle) > 1e-2)


def test_dhash_by_hand():
    px = np.tile(np.arange(9, dtype=np.uint8) * 10, (8, 1))
    px[3] = px[3, ::-1]
    assert raster.dhash(px) == 0xFF << 24


def grey_png(rows, depth, kind=0, extra=b"", interlace=0):
    """A PNG by hand: packed rows, each behind a filter byte of none."""
    import struct
    import zlib

    def part(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    (h, w), data = rows[0], b"".join(b"\0" + r for r in rows[1])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlace)) + extra + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_png_depths(depth):
    want = RNG.integers(0, 1 << depth, (5, 7))
    packed = []
    for row in want:
        bits = "".join(f"{v:0{depth}b}" for v in row)
        bits += "0" * (-len(bits) % 8)
        packed.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)))
    px = png.decode(grey_png(((5, 7), packed), depth))
    shown = want >> 8 if depth == 16 else want * (255 // ((1 << depth) - 1))
    assert (px == shown[..., None]).all()


def test_png_interlaced():
    want = RNG.integers(0, 256, (11, 13)).astype(np.uint8)
    passes = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]
    rows = [r.tobytes() for y, x, dy, dx in passes for r in want[y::dy, x::dx] if r.size]
    assert (png.decode(grey_png(((11, 13), rows), 8, interlace=1)) == want[..., None]).all()


def lzw(values, least):
    """Plain compression with codes that grow and tables that fill up."""
    clear, end = 1 << least, (1 << least) + 1
    table, width, out, n = {(i,): i for i in range(clear)}, least + 1, clear, least + 1
    code, run = end + 1, ()
    for v in values:
        if (*run, v) in table:
            run = (*run, v)
            continue
        out |= table[run] << n
        n += width
        if code < 4096:
            table[(*run, v)] = code
            code += 1
            if code - 1 == 1 << width and width < 12:
                width += 1
        else:
            out |= clear << n
            n += width
            table, width, code = {(i,): i for i in range(clear)}, least + 1, end + 1
        run = (v,)
    out |= table[run] << n
    n += width
    out |= end << n
    return out.to_bytes((n + width + 7) // 8, "little")


@pytest.mark.parametrize("interlaced,clear", [(False, None), (True, None), (False, 3)])
def test_gif_compressed(interlaced, clear):
    import struct

    index = np.random.default_rng(4).integers(0, 16, (60, 190)).astype(np.uint8)
    index[20:40] = 5
    colours = RNG.integers(0, 256, (16, 3)).astype(np.uint8)
    order = [*range(0, 60, 8), *range(4, 60, 8), *range(2, 60, 4), *range(1, 60, 2)] if interlaced else range(60)
    packed = lzw([int(v) for y in order for v in index[y]], 4)
    blocks = b"".join(bytes([len(packed[i : i + 255])]) + packed[i : i + 255] for i in range(0, len(packed), 255))
    control = b"" if clear is None else b"!\xf9\x04" + bytes([1, 0, 0, clear]) + b"\0"
    data = b"GIF89a" + struct.pack("<HHBBB", 190, 60, 0x83, 0, 0) + colours.tobytes() + control + b"," + struct.pack("<HHHHB", 0, 0, 190, 60, 0x40 * interlaced) + b"\x04" + blocks + b"\0;"
    px = gif.decode(data)
    solid = np.ones_like(index, dtype=bool) if clear is None else index != clear
    assert (px[solid] == colours[index][solid]).all()


def java_jpeg(spark, px, progressive, colour=True):
    """(file, pixels) as Java's own encoder and decoder have them; colour is subsampled by two both ways."""
    java = spark._jvm.java
    image_io, out = spark._jvm.javax.imageio.ImageIO, java.io.ByteArrayOutputStream()
    h, w = px.shape[:2]
    image = java.awt.image.BufferedImage(w, h, 5 if colour else 10)
    image.getRaster().setDataElements(0, 0, w, h, bytearray((px if colour else px[..., 0]).tobytes()))
    writer = image_io.getImageWritersByFormatName("jpeg").next()
    how = writer.getDefaultWriteParam()
    if progressive:
        how.setProgressiveMode(1)
    stream = image_io.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, spark._jvm.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    data = bytes(out.toByteArray())
    back = image_io.read(java.io.ByteArrayInputStream(bytearray(data))).getRaster().getDataBuffer().getData()
    return data, np.frombuffer(bytes(back), dtype=np.uint8).reshape(h, w, -1)[..., ::-1]


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("colour", [False, True])
@pytest.mark.parametrize("shape", [(40, 48), (37, 51)])
def test_jpeg_agrees_with_java(spark, shape, colour, progressive):
    texture = raster.resize(np.random.default_rng(8).integers(60, 190, (9, 11)).astype(np.uint8), shape[1], shape[0])
    tint = np.stack([np.linspace(-40, 40, shape[1])[None].repeat(shape[0], 0), np.linspace(30, -30, shape[0])[:, None].repeat(shape[1], 1), np.full(shape, 20)], axis=2)
    px = (texture[..., None] + tint).astype(np.uint8)
    data, want = java_jpeg(spark, px, progressive, colour)
    gap = np.abs(jpeg.decode(data).astype(int) - want)
    assert (b"\xff\xc2" in data) == progressive
    assert gap.max() <= (8 if colour else 2) and gap.mean() < 1.5  # chroma, which changes slowly here, is enlarged by another rule there


def test_exif_of_a_heif_file():
    import struct

    tiff = write_exif_jpeg("Maker", "2021:02:03 04:05:06", 3)[12:-2]
    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    full = lambda kind, body, version=0: box(kind, bytes([version, 0, 0, 0]) + body)
    item = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    infe = full(b"infe", struct.pack(">HH", 1, 0) + b"Exif\0", 2)
    head = box(b"ftyp", b"heic\0\0\0\0mif1")

    def meta(offset):
        iloc = full(b"iloc", b"\x44\x00" + struct.pack(">HHHHII", 1, 1, 0, 1, offset, len(item)))
        return full(b"meta", full(b"iinf", struct.pack(">H", 1) + infe) + iloc)

    data = head + meta(len(head) + len(meta(0)) + 8) + box(b"mdat", item)
    found = exif.parse(data)
    assert (found["make"], found["modified"], found["orientation"]) == ("Maker", "2021:02:03 04:05:06", 3)


def test_command_line():
    from argentic import cli

    assert cli.parse(["pics", "--port", "81", "--no-index"]) == cli.Options("pics", 81, None, True)
    assert cli.parse(["pics", "-h"]) is None
    for bad in ([], ["a", "b"], ["a", "--port"], ["a", "--port", "0"], ["a", "--port", "x"], ["--prot", "a"]):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)


def test_progress_starts_anew():
    from argentic.streaming import reindex

    p = reindex.Progress()
    p.done, p.finished = 3, True
    assert p.event(4, 2) == 'data: {"done":3,"total":4,"indexed":2,"indexing":false}\n\n' and p.percent(4) == 75
    p.reset()
    assert (p.done, p.finished, p.percent(0)) == (0, False, 0)


def test_folder_build_is_incremental(spark, tmp_path):
    from argentic.plans import catalog

    root, index = tmp_path / "photos", tmp_path / "index"
    (root / "sub").mkdir(parents=True)
    (root / "a.png").write_bytes(png.encode(scene()))
    (root / "sub" / "b.png").write_bytes(png.encode(raster.resize(scene(), 135, 90)))
    (root / "_c.txt").write_text("no image")
    (root / ".hidden.png").write_bytes(png.encode(photo(4, 4)))
    (root / "bad.png").write_bytes(png.encode(photo(9, 9))[:40])
    (root / "link.png").symlink_to(root / "a.png")
    with pytest.raises(ValueError):
        catalog.serve(spark, str(root), str(index))
    entries, stats = catalog.build(spark, str(root), str(index))
    s = stats.first()
    assert (s["files_seen"], s["images"], s["reused"], s["decoded"], s["failed"], s["unreadable"]) == (4, 3, 0, 3, 1, 0)
    assert sorted(r["rel"] for r in catalog.serve(spark, str(root), str(index)).collect()) == ["a.png", "bad.png", "sub/b.png"]
    gone = spark.createDataFrame([(str(root / "gone.png"), 1, 1)], "path string, bytes long, mtime long")
    assert [r["state"] for r in folder.read_images(gone).collect()] == ["unreadable"]
    assert sorted(r["rel"] for r in entries.collect()) == ["a.png", "bad.png", "sub/b.png"]
    found = catalog.cluster_items(entries).collect()
    assert len(found) == 1 and len(found[0]["ids"]) == 2
    assert found[0]["best"] == entries.filter("rel = 'a.png'").first()["id"]
    (root / "sub" / "b.png").unlink()
    entries, stats = catalog.build(spark, str(root), str(index))
    s = stats.first()
    assert (s["images"], s["reused"], s["decoded"]) == (2, 2, 0)
    assert catalog.by_id(entries, catalog.photo_json(entries).first()["json"][7:23]).count() == 1
    assert folder.load_index(spark, "/elsewhere", str(index)) is None


@pytest.mark.parametrize("n", [2048, 40000])
def test_flat_jpegs_have_a_block_for_every_byte(n, monkeypatch):
    seen, write = [], queries.write_flat_jpeg
    monkeypatch.setattr(queries, "write_flat_jpeg", lambda means: seen.append(means) or write(means))
    data = RNG.integers(0, 256, n).astype(np.uint8).tobytes()
    assert queries.flat_jpeg_same(data) and np.concatenate(seen).tobytes()[:n] == data


def test_whole_baseline_scans_are_read_by_tables(spark, monkeypatch):
    files = [write_flat_jpeg(RNG.integers(0, 256, (5, 7)))] + [java_jpeg(spark, photo(40, 33), False, colour)[0] for colour in (True, False)]
    found = [jpeg.decode(f) for f in files]

    def none(*_):
        raise jpeg._Odd

    with monkeypatch.context() as m:
        m.setattr(jpeg, "_scan_by_tables", none)
        assert all((jpeg.decode(f) == px).all() for f, px in zip(files, found, strict=True))
        halves = [jpeg.decode(f[: len(f) - 9]) for f in files]
    assert all((jpeg.decode(f[: len(f) - 9]) == px).all() for f, px in zip(files, halves, strict=True))
    monkeypatch.setattr(jpeg, "_baseline", none)
    assert all((jpeg.decode(f) == px).all() for f, px in zip(files, found, strict=True))
