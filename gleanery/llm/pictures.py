"""The picture operators of the core, under the name by which the operators for training data know them."""

from gleanery.operators.pictures import *  # noqa: F403
