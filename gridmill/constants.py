"""Fixed values of the data model and defaults."""

from __future__ import annotations

#: The class palette, and the shape of the default forest.
CLASS_COLORS = ("#ff595e", "#ffca3a", "#8ac926", "#1982c4")
NUM_CLASSES = 4
NUM_TREES = 8
MAX_DEPTH = 8
NUM_FEATURES = 8
MIN_LABELS_TO_TRAIN = 5

#: Class membership: the probability is at least this (not the largest of all).
MEMBER_THRESHOLD = 0.5
OVERLAY_ALPHA = 0.4
#: The filter bank's scale where none is given.
DEFAULT_SIGMA = 1.0
#: The second scale of the difference of Gaussians, as a share of the first.
SECOND_SCALE = 0.66
#: Fixed value: the filter bank's widest kernel reaches so many pixels to either side.
MAX_RADIUS = 32

MARKER_MIN_RADIUS = 1.5
MARKER_LOG_SCALE = 1.6

DEBOUNCE_MS = 300
FRAME_MS = 16

#: Largest value of each sample type; floating types have none.
DTYPE_MAX = {
    "uint8": 255, "int8": 127, "uint16": 65535, "int16": 32767, "uint32": 4294967295, "int32": 2147483647,
}
FLOAT_SCALE = 1000

IMAGE_SUFFIXES = r"\.(tiff?|png|jpe?g)$"
