"""What is done with documents; each module is one step of the way, its functions carry the survey's ids."""
