"""Velaria: find, mask, restore and audit personal data in Spark tables and streams.

Every public function takes DataFrames (or Columns) and returns them; nothing here calls an
action.  Start with :mod:`velaria.operators.detect` (span tables) and
:mod:`velaria.operators.masking` (placeholders, vaults, restoring).
"""

__version__ = "0.1.0"
