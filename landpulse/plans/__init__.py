"""Named queries; importing this package registers all of them."""

from landpulse.plans import alignment, catalog, detection, expressions, learning, series, summaries, validation  # noqa: F401
