"""Named constants of the label-recognition domain."""

# Fixed values.
CONFUSABLE_PAIRS = ("8B", "5S", "0O", "1I", "2Z")
IDENTIFYING_MIN_LEN = 5
SPLIT_SEED = 42
SPLIT_RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}
CURVED_FOLDS = 5
IOU_THRESHOLD = 0.5
INSIDE_RATIO = 0.5
LENGTH_BINS = ((1, 2), (3, 4), (5, 8), (9, 14), (15, 40))
ANGLE_TOLERANCE_DEGREES = 20.0
OFFSET_RATIO = 0.7
CANDIDATE_GAP = 1.5
FLIP_POLICIES = ("none", "classifier", "confidence")
CONDITIONAL_RECOGNITION = 0.856
EXTRA_CHANNELS = 2  # the space and the blank
EPSILON = 1e-9
