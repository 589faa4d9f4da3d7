import numpy as np

from loomwork.llm import media


def test_cut_after_the_first_frame():
    planes = np.concatenate([np.full((1, 64, 64), 20), np.full((1, 64, 64), 200)]).astype(np.uint8)
    assert [(a, b, n) for a, b, n, _ in media.shots(planes, 40)] == [(0, 40, 1), (40, 80, 1)]
    assert len(media.shots(planes[[0, 0]], 40)) == 1
