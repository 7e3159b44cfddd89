"""Short tandem repeats, k-mer graphs and read clean-up as Spark DataFrame jobs."""
