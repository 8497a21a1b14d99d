"""Streams of images: faults aside, progress reported."""

import time

import numpy as np

from somatica.sources import tiff
from somatica.streaming import watch


def test_faults_and_progress(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        data = tiff.encode(np.full((4, 5), k, "u1"), 0.5)
        (folder / f"img{k}.tif").write_bytes(data if k % 3 else b"broken")
    progress = watch.Progress()
    spark.streams.addListener(progress)
    try:
        query = watch.decode_arriving(watch.arriving(spark, str(folder), per_batch=2), f"{tmp_path}/out", f"{tmp_path}/state", "arrivals")
        query.awaitTermination()
        (folder / "late.tif").write_bytes(tiff.encode(np.ones((2, 2), "u1")))
        watch.decode_arriving(watch.arriving(spark, str(folder), per_batch=2), f"{tmp_path}/out", f"{tmp_path}/state", "arrivals").awaitTermination()
        until = time.monotonic() + 20
        while len(progress.ended) < 2 and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    good, bad = watch.arrived(spark, f"{tmp_path}/out").collect(), watch.arrived(spark, f"{tmp_path}/out", "faults").collect()
    assert {r.filename for r in good} == {"img1.tif", "img2.tif", "img4.tif", "img5.tif", "late.tif"} and all(r.error is None for r in good)
    assert {r.filename for r in bad} == {"img0.tif", "img3.tif"} and all(r.error for r in bad)
    told = [r["observed"]["decoding"] for r in progress.reports if "decoding" in r["observed"] and r["rows"]]
    assert len(progress.started) == 2 and len(progress.ended) == 2 and all(e is None for _, e in progress.ended)
    assert len(told) == 4 and sum(t["files"] for t in told) == 7 and sum(t["faults"] for t in told) == 2
