"""A PySpark engine for queries over versioned terminologies and other component hierarchies."""
