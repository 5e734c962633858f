"""Storage formats packed bit by bit here, read in one range and in many."""

from __future__ import annotations

import numpy as np
import pytest

from beatloom.sources import wfdb

BITS = {16: 16, 61: 16, 160: 16, 24: 24, 32: 32, 212: 12, 310: 10, 311: 10}


def packed(values, fmt):
    """Bytes of a storage format, from the words of its published layout."""
    v = [int(x) for x in values]
    if fmt in (16, 61, 24, 32):
        return b"".join(x.to_bytes(BITS[fmt] // 8, "big" if fmt == 61 else "little", signed=True) for x in v)
    if fmt == 160:
        return b"".join((x + 32768).to_bytes(2, "little") for x in v)
    group = 2 if fmt == 212 else 3
    v += [0] * (-len(v) % group)
    out = b""
    for k in range(0, len(v), group):
        u = [x % (1 << BITS[fmt]) for x in v[k : k + group]]
        if fmt == 212:
            out += bytes([u[0] & 255, u[0] >> 8 | (u[1] >> 8) << 4, u[1] & 255])
        elif fmt == 310:
            out += (u[0] << 1 | (u[2] & 31) << 11).to_bytes(2, "little") + (u[1] << 1 | (u[2] >> 5) << 11).to_bytes(2, "little")
        else:
            out += (u[0] | u[1] << 10 | u[2] << 20).to_bytes(4, "little")
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root, rng, truth = tmp_path_factory.mktemp("formats"), np.random.default_rng(5), {}
    for fmt, bits in BITS.items():
        top = 1 << (bits - 1)
        x = rng.integers(-top, top, (501, 2))
        x[:2] = [[-top, top - 1], [0, -1]]
        name = f"r{fmt}"
        (root / f"{name}.dat").write_bytes(b"\0" * 7 + packed(x.ravel(), fmt))
        lines = [f"{name}.dat {fmt}+7 {gain}({base})/mV 12 0" for gain, base in ((100, 3), (50, -2))]
        # the third signal has a file of its own
        (root / f"{name}b.dat").write_bytes(packed(x[:, 0] // 2, fmt))
        lines.append(f"{name}b.dat {fmt} 10 12 5")
        (root / f"{name}.hea").write_text("\n".join([f"{name} 3 100 501", *lines]) + "\n")
        truth[name] = [(x[:, 0] - 3) / 100, (x[:, 1] + 2) / 50, (x[:, 0] // 2 - 5) / 10]
    return str(root), truth


@pytest.mark.parametrize("channel", [0, 1, 2])
@pytest.mark.parametrize("seconds", [0.62, 100.0])
def test_round_trips(spark, folder, channel, seconds):
    root, truth = folder
    rows = wfdb.read_signals(spark, root, seconds, 0.3, channel).orderBy("record_id", "start").collect()
    for name, channels in truth.items():
        mine = [r for r in rows if r["record_id"] == name]
        for r in mine:
            assert np.allclose(r["y"], channels[channel][r["start"] : r["start"] + len(r["y"])])
        cores = np.concatenate([r["y"][r["lead"] : r["lead"] + r["core"]] for r in mine])
        assert len(mine) == (9 if seconds < 1 else 1) and np.allclose(cores, channels[channel]), name


def test_counts_from_the_size_of_files(spark, tmp_path):
    for fmt in (24, 212, 310, 311):
        (tmp_path / f"s{fmt}.dat").write_bytes(b"\0" * 4 + packed(range(60), fmt))
        (tmp_path / f"s{fmt}.hea").write_text(f"s{fmt} 2 100\ns{fmt}.dat {fmt}+4 100\ns{fmt}.dat {fmt}+4 100\n")
    assert {r["n_samples"] for r in wfdb.read_headers(spark, str(tmp_path)).collect()} == {30}


@pytest.mark.parametrize("what", ["16x4", "16:3"])
def test_what_cannot_be_read_raises(spark, tmp_path, what):
    (tmp_path / "x.dat").write_bytes(bytes(80))
    (tmp_path / "x.hea").write_text(f"x 1 100 10\nx.dat {what} 100\n")
    with pytest.raises(Exception, match="not supported"):
        wfdb.read_signals(spark, str(tmp_path)).collect()


def test_no_such_channel_raises(spark, folder):
    with pytest.raises(Exception, match="no channel 3"):
        wfdb.read_signals(spark, folder[0], channel=3).collect()
