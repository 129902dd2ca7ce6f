"""JPEG against the JVM's codec, files as results, files as a stream."""

import os

import numpy as np
import pytest

from penumbra.operators import image, jpeg
from penumbra.operators.engine import Readers, redact_files
from penumbra.sources import filesink
from penumbra.sources.errors import RedactError
from penumbra.streaming import stream


def smooth(h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.stack([x * 255 / w, y * 255 / h, 128 + 60 * np.sin((x + y) / 20)], 2).astype(np.uint8)


def of_jvm(spark, content):
    """Pixels as the JVM decodes them."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
    w, h = picture.getWidth(), picture.getHeight()
    flat = spark._sc._gateway.new_array(jvm.int, w * h)
    picture.getRGB(0, 0, w, h, flat, 0, w)
    n = np.array([flat[i] for i in range(w * h)], np.int64).reshape(h, w) & 0xFFFFFF
    return np.stack([n >> 16, n >> 8 & 255, n & 255], 2)


def by_jvm(spark, pixels, progressive):
    """A JPEG that the JVM writes; it halves the colours' resolution."""
    jvm, (h, w) = spark._jvm, pixels.shape[:2]
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in pixels[y, x])
            picture.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), param)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 33), (40, 50)])
def test_what_is_written_is_read_alike_by_the_jvm(spark, shape):
    pixels = smooth(*shape)
    made = jpeg.encode(pixels, 95)
    own, other = jpeg.decode(made).astype(int), of_jvm(spark, made)
    assert own.shape == (*shape, 3) and np.abs(own - other).max() <= 2 and np.abs(own - pixels).mean() < 2


@pytest.mark.parametrize("progressive", [False, True])
def test_what_the_jvm_writes_is_read(spark, progressive):
    pixels = smooth(37, 45)
    made = by_jvm(spark, pixels, progressive)
    assert (b"\xff\xc2" in made) == progressive
    own, other = jpeg.decode(made).astype(int), of_jvm(spark, made)
    assert own.shape == pixels.shape and np.abs(own - other).mean() < 1 and np.abs(own - other).max() <= 4


@pytest.mark.parametrize(("format", "kind", "interlaced"), [("png", 1, False), ("png", 1, True), ("png", 12, False), ("png", 12, True), ("png", 13, False), ("png", 11, False), ("png", 10, True), ("png", 2, True), ("gif", 13, False), ("gif", 12, True), ("bmp", 1, False), ("bmp", 12, False), ("bmp", 13, False)])
def test_other_pictures_of_the_jvm_are_read(spark, format, kind, interlaced):
    """Its kinds: 1 RGB, 2 with alpha, 10 and 11 gray of 8 and 16 bits, 12 of two colours, 13 with a palette."""
    jvm, (h, w) = spark._jvm, (13, 21)
    picture, pixels = jvm.java.awt.image.BufferedImage(w, h, kind), smooth(h, w)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in pixels[y, x])
            picture.setRGB(x, y, -16777216 | r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(format).next()
    param = writer.getDefaultWriteParam()
    if interlaced:
        param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), param)
    writer.getOutput().flush()
    made = bytes(out.toByteArray())
    own, other = image.decode(made), of_jvm(spark, made)
    assert own.shape[:2] == (h, w)
    if kind in (10, 11):  # the JVM brightens gray on its way to RGB, so its own numbers are compared
        raster = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(made)).getRaster()
        assert own[:, :, 0].tolist() == [[raster.getSample(x, y, 0) >> (8 if kind == 11 else 0) for x in range(w)] for y in range(h)]
    else:
        rgb = own[:, :, :3] if own.shape[2] > 2 else np.repeat(own[:, :, :1], 3, 2)
        assert np.array_equal(rgb, other)


def test_pictures_that_are_broken():
    for mark in (b"GIF89a", b"BM", b"GIF8", b"BM" + b"\0" * 60, b"GIF89a\1\0\1\0\0\0\0;"):
        with pytest.raises(RedactError):
            image.decode(mark)


def test_gray_noise_restarts_and_broken_files():
    noise = np.random.default_rng(1).integers(0, 256, (64, 72, 3)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 4
    gray = smooth(30, 20)[:, :, :1]
    assert jpeg.decode(jpeg.encode(gray, 100)).shape == (30, 20, 1) and np.abs(jpeg.decode(jpeg.encode(gray, 100)).astype(int) - gray).max() <= 2
    made = jpeg.encode(noise)
    for broken in (b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", made[:300], b"\xff\xd8" + made[200:], made.replace(b"\xff\xc0", b"\xff\xc3")):
        with pytest.raises(RedactError):
            jpeg.decode(broken)


def test_a_jpeg_stays_one(spark):
    pixels = np.full((60, 120, 3), 255, np.uint8)
    words = lambda p: [{"word": "a@b.io", "x": 10, "y": 5, "width": 20, "height": 10}]
    df = spark.createDataFrame([("j", bytearray(jpeg.encode(pixels))), ("p", bytearray(image.png_encode(pixels)))], "name string, content binary").selectExpr("*", "'image' AS kind", "CAST(NULL AS STRING) AS format")
    got = {r["name"]: bytes(r["redacted_bytes"]) for r in redact_files(df, readers=Readers(ocr=words)).collect()}
    assert got["j"][:2] == b"\xff\xd8" and got["p"][:4] == b"\x89PNG"
    assert jpeg.decode(got["j"])[14:28, 24:58].max() < 30 and jpeg.decode(got["j"])[:8].min() > 225
    lossless, small = image.image_pdf([smooth(200, 200)]), image.image_pdf([smooth(200, 200)], quality=90)
    assert b"/DCTDecode" in small and len(small) < len(lossless) / 3


def test_files_of_their_own(spark, tmp_path):
    spark.dataSource.register(filesink.Files)
    rows = [("a/x.png", b"1"), ("b/x.png", b"2"), ("y", b"3"), ("none.pdf", None), ("c\\z.tar.gz", b"4")]
    df = spark.createDataFrame([(p, bytearray(c) if c else None) for p, c in rows], "path string, redacted_bytes binary").repartition(3)
    out = str(tmp_path / "out")
    df.write.format("penumbra_files").option("folder", out).mode("append").save()
    assert sorted(os.listdir(out)) == ["x.2.redacted.out", "x.redacted.out", "y.redacted.out", "z.tar.redacted.out"]
    assert sorted(open(f"{out}/{n}", "rb").read() for n in os.listdir(out)) == [b"1", b"2", b"3", b"4"]
    df.limit(1).write.format("penumbra_files").option("folder", out).mode("append").save()
    assert len(os.listdir(out)) == 5
    fails = df.selectExpr("path", "CASE WHEN path = 'y' THEN CAST(raise_error('no') AS BINARY) ELSE redacted_bytes END AS redacted_bytes")
    with pytest.raises(Exception, match="no"):
        fails.write.format("penumbra_files").option("folder", out).mode("append").save()
    assert len(os.listdir(out)) == 5


def test_files_as_a_stream_each_once_over_a_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))
    os.makedirs(source)

    def arrive(name, content):
        with open(f"{source}/{name}", "wb") as f:
            f.write(content)

    def run():
        query = stream.write_files(stream.read_files(spark, source, 1), out, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(240)

    arrive("a.txt", b"mail a@b.io")
    arrive("b.csv", b"x,y\nb@b.io,1\n")
    run()
    arrive("c.txt", b"c@b.io")
    run()
    got = {os.path.basename(r["path"]): r["redacted_markdown"] for r in spark.read.parquet(out).collect()}
    assert got == {"a.txt": "mail ██████", "b.csv": "| x | y |\n| --- | --- |\n| ██████ | 1 |\n", "c.txt": "██████"}
    assert spark.read.parquet(out).count() == 3
