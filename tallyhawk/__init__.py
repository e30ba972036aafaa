"""tallyhawk: accounts-payable risk analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames; nothing is collected to
the driver except bounded artefacts (forest trees, quantile brackets).
"""

__version__ = "0.1.0"
