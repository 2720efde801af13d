"""Factor analytics on Spark: DataFrame operators for latent factors of cells and regions.

Every operator takes column names as arguments and returns a lazy DataFrame. Jobs that run
while a plan is being built (split points, guards, small lookups) return a bounded number
of rows and are named in the docstring of the function that runs them.
"""

__version__ = "0.1.0"
