"""Supervised and unsupervised model fitting over prepared feature arrays."""
