"""docquarry: document search, question answering and corpus preparation on Spark."""
