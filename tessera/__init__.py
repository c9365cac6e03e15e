"""tessera: a deductive analytics engine whose rules compile to Spark DataFrame plans."""
