import numpy as np
import pytest

from geospan.__main__ import main
from geospan.config import Config
from geospan.operators import arrays as A
from tests.test_operators import array_of, grid_of


def test_zoom_keeps_corners_and_cubics():
    x = np.random.default_rng(1).normal(size=(6, 9))
    big = A.cubic_zoom(x, 2.0)
    assert big.shape == (12, 18) and np.allclose(big[[0, 0, -1, -1], [0, -1, 0, -1]], x[[0, 0, -1, -1], [0, -1, 0, -1]])
    assert np.allclose(A.cubic_zoom(x, 1.0), x)
    assert np.allclose(A.cubic_zoom(np.full((5, 5), 3.0), 1.7), 3.0)


def test_unwrapping_a_ramp(spark):
    r, c = np.indices((20, 24))
    true = 0.7 * r + 0.4 * c
    wrapped = np.angle(np.exp(1j * true))
    found = array_of(A.by_array(grid_of(spark, wrapped), A.flood_unwrap), "z", true.shape)
    assert np.allclose(found - found[10, 12], true - true[10, 12])


def test_low_coherence_stops():
    phase = np.tile(np.angle(np.exp(1j * np.arange(9) * 2.0)), (3, 1))
    coherence = np.ones((3, 9))
    coherence[:, 6] = 0
    found = A.flood_unwrap(phase, coherence)
    assert np.allclose(found[:, 7:], phase[:, 7:])


def test_augmenting_is_seeded():
    x = np.arange(12.0).reshape(1, 3, 4)
    assert all((A.augment(x, s) == A.augment(x, s)).all() for s in range(8)) and {A.augment(x, s).shape for s in range(20)} == {(1, 3, 4), (1, 4, 3)}


def test_settings(tmp_path):
    config = Config().update(tile_size=256, threshold=0.7, nothing=1)
    config.to_file(str(tmp_path / "c.json"))
    assert Config.from_file(str(tmp_path / "c.json")) == config and config.processing.tile_size == 256


def test_command_line(capsys):
    assert main(["list"]) == 0 and "zonal_raster" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main([])
